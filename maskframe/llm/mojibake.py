"""Text that was decoded with the wrong character encoding: find it and restore it where possible.

A garbled span is undone by mapping its characters back to the bytes of a legacy code page and reading the
bytes as what they were. A byte-structure automaton (a regular expression over bytes, hence a finite
automaton) finds the maximal well-formed multibyte spans of UTF-8 or of GBK in those bytes; only such spans,
cut to whole characters, are decoded. Structure alone is weak evidence for double-byte code pages, so a span
must also become more likely text: its characters before and after are compared by their frequency in the
whole column set, a table of at most one row for each code point. Copies of a garbled value must not make its
own wrong characters likely, so a value is judged as if it stood there once, and by counts over distinct values.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.plans.checkpoints import Cuts

#: Code pages a text may have been read in by mistake; cp1252 stands for Latin-1 too (its gaps pass through).
SINGLE_BYTE = ["cp1252", "mac_roman", "cp1251", "cp437", "cp850", "koi8_r", "cp1250", "cp866"]
DOUBLE_BYTE = ["gb18030", "cp932", "cp949", "cp950"]
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
GBK = re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9])+")
#: True encoding -> its automaton, and the code pages it is looked for in.
TARGETS = [
    ("utf-8", UTF8, SINGLE_BYTE + DOUBLE_BYTE),
    ("gb18030", GBK, ["cp1252", "mac_roman", "cp932", "cp949", "cp950"]),
]
#: Two neighbours that single-byte code pages have beyond ASCII; without them none of those pages can hold a span.
HIGH_PAIR = re.compile("[" + "".join(sorted({bytes([b]).decode(c, "ignore") for c in SINGLE_BYTE for b in range(128, 256)} | {chr(x) for x in range(128, 160)})).replace("]", r"\]").replace("\\", r"\\") + "]{2}")
#: What UTF-8 read in cp866 holds and Russian text does not.
BOX = re.compile("[\u2500-\u259f]")
C1 = re.compile("[\x80-\x84\x86-\x9f]")
LOST = "�"
#: Least gain in log likelihood of a span that is accepted: by single-byte and by double-byte code page, and
#: for GBK in a double-byte page, where structure proves nothing, the least gain a character; and of one GBK
#: pair alone in a single-byte page.
MIN_GAIN, MIN_GAIN_DOUBLE, MIN_GAIN_CHAR, MIN_GAIN_PAIR = 3.0, 4.0, 2.5, 8.0
CHINESE = re.compile("[\x00-\x7f\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]*")
#: Other encodings that the bytes of a GBK reading may belong to as well: double-byte ones, and single-byte ones of other scripts.
RIVALS, RIVAL_LETTERS = ["cp949", "euc_jp", "cp932", "cp950"], ["cp1251", "koi8_r", "cp1253"]
#: Least part of a reading's new characters that other values hold, for it to be believed against a rival.
FAMILIAR = 0.75
STRICT = {f"utf-8 via {c}" for c in SINGLE_BYTE}


class _Bytes(dict):
    """Filled on use: character -> bytes in the code page, b"" where it has none of one or two bytes."""

    def __init__(self, codec: str):
        self.codec = codec

    def __missing__(self, ch: str) -> bytes:
        try:
            b = ch.encode(self.codec)
        except UnicodeEncodeError:
            b = bytes([ord(ch)]) if self.codec == "cp1252" and "\x80" <= ch <= "\xff" else b""
        self[ch] = b = b if len(b) <= 2 else b""
        return b


class _Decoded(dict):
    """Filled on use: one sequence of bytes -> text in the encoding, None where there is none."""

    def __init__(self, target: str):
        self.target = target

    def __missing__(self, raw: bytes) -> str | None:
        try:
            good = raw.decode(self.target)
        except UnicodeDecodeError:
            good = None
        if len(raw) <= 4:
            self[raw] = good
        return good


@lru_cache(maxsize=None)
def _char_bytes(codec: str) -> _Bytes:
    return _Bytes(codec)


@lru_cache(maxsize=None)
def _decoded(target: str) -> _Decoded:
    return _Decoded(target)


def to_bytes(ch: str, codec: str) -> bytes:
    return _char_bytes(codec)[ch]


@lru_cache(maxsize=None)
def _prior(ch: str) -> float:
    """Pseudo-count of a character that the table may lack: everyday characters get more."""
    o = ord(ch)
    if o < 0x80:
        return 1.0
    if 0xE000 <= o <= 0xF8FF or o >= 0xF0000 or 0x80 <= o < 0xA0 or not ch.isprintable():
        return 0.001
    if o < 0x250 or 0x400 <= o < 0x460 or 0x2010 <= o <= 0x2040 or 0x3000 <= o < 0x3100:
        return 0.3
    for codec, first, last in (("gb2312", 0xB0, 0xD7), ("euc_kr", 0xB0, 0xC8), ("big5", 0xA4, 0xC6)):
        try:
            return 0.5 if first <= ch.encode(codec)[0] <= last else 0.1
        except UnicodeEncodeError:
            continue
    return 0.02


class _Less:
    """Counts without ``times`` those of one text."""

    def __init__(self, counts: dict[str, int], text: str, times: int):
        self.counts, self.own, self.times = counts, Counter(text), times

    def get(self, ch: str, default: int = 0) -> int:
        return max(self.counts.get(ch, default) - self.times * self.own.get(ch, 0), 0)

    def __contains__(self, ch: str) -> bool:
        return self.get(ch) > 0


class Likelihood(dict):
    """Log probability of single characters, from counts and a small prior; filled on use."""

    def __init__(self, counts: dict[str, int], size: int | None = None):
        self.counts, self.size = counts, sum(counts.values()) if size is None else size
        self.total = math.log(max(self.size, 0) + 1000.0)

    def without(self, text: str, times: int) -> Likelihood:
        """The same without so many copies of ``text``."""
        return Likelihood(_Less(self.counts, text, times), self.size - times * len(text)) if times > 0 else self

    def __missing__(self, ch: str) -> float:
        p = self[ch] = math.log(self.counts.get(ch, 0) + _prior(ch)) - self.total
        return p

    def of(self, text: str) -> float:
        return sum(map(self.__getitem__, text))


def spans(text: str, codec: str, target: str, automaton: re.Pattern, logp: Likelihood) -> list[tuple[float, int, int, str]]:
    """Decodable spans of ``text``: (gain, first, end, restored)."""
    known, decoded, starts = _char_bytes(codec), _decoded(target), None
    parts = [known[c] or b"\n" for c in text]
    data = b"".join(parts)
    found = []
    for m in automaton.finditer(data):
        if starts is None:
            starts = [0, *accumulate(map(len, parts))]
        raw, base = m.group(), m.start()
        # Cut the span into the smallest pieces that are whole on both sides: characters and sequences.
        pieces, last, pos, at, first, gains = [], -1, 0, bisect_left(starts, base), 0, False
        while True:
            while starts[at] < base + pos:
                at += 1
            if starts[at] == base + pos:
                if last >= 0:
                    good = decoded[raw[last:pos]]
                    if good is not None:
                        gain = logp[good] - logp[text[first]] if at == first + 1 and len(good) == 1 else logp.of(good) - logp.of(text[first:at])
                        pieces.append((gain, first, at, good))
                        gains = gains or gain > 0
                last, first = pos, at
            if pos == len(raw):
                break
            if target == "utf-8":
                lead = raw[pos]
                pos += 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            else:
                pos += 4 if 0x30 <= raw[pos + 1] <= 0x39 else 2
        if not gains:
            continue
        # Best run of pieces: ends that only lower the likelihood are left as they are.
        best, total, first = (0.0, 0, 0), 0.0, 0
        for k, piece in enumerate(pieces):
            if total <= 0 or pieces[k - 1][2] != piece[1]:
                first, total = k, 0.0
            total += piece[0]
            if total > best[0]:
                best = (total, first, k + 1)
        run = pieces[best[1] : best[2]]
        good = "".join(p[3] for p in run)
        if run and good != text[run[0][1] : run[-1][2]]:
            found.append((best[0], run[0][1], run[-1][2], good))
    return found


def _sure(text: str, target: str, codec: str, got: list[tuple], logp: Likelihood) -> bool:
    """Whether structure and likelihood of one of the spans, or of several short ones, rule out chance."""
    short = 0
    for gain, i, j, good in got:
        if codec in SINGLE_BYTE:
            # One character may come from a chance pair: then it has to be one that texts do have.
            known = len(good) > 1 or logp.counts.get(good, 0) > 0 or _prior(good) >= 0.3
            if known and gain >= MIN_GAIN and (target == "utf-8" or j - i >= 4 or (gain >= MIN_GAIN_PAIR and good in logp.counts)):
                return True
        elif j - i >= 2:
            if gain >= MIN_GAIN_DOUBLE and (target == "utf-8" or gain >= MIN_GAIN_CHAR * (j - i)):
                return True
        elif (i == 0 or text[i - 1].isascii()) and (j == len(text) or text[j].isascii()) and len(text) > 1 and gain >= MIN_GAIN_DOUBLE:
            # A lone double-byte character counts among Latin text only, and for GBK not alone.
            short += 1
            if target == "utf-8" or short >= 2:
                return True
    return False


def undo(text: str, logp: Likelihood) -> tuple[str, str] | None:
    """(text with one level of wrong decoding undone, "true encoding via code page"), or None."""
    found: list[tuple] = []
    single = HIGH_PAIR.search(text) is not None
    for target, automaton, codecs in TARGETS:
        for codec in codecs:
            if codec in SINGLE_BYTE and not single or codec == "cp866" and not BOX.search(text):
                continue
            got = spans(text, codec, target, automaton, logp)
            if _sure(text, target, codec, got, logp):
                strict = target == "utf-8" and codec in SINGLE_BYTE
                found.append((sum(g[0] for g in got), sum(g[2] - g[1] for g in got), strict, got, f"{target} via {codec}"))
    if not found:
        return None
    best = max(found, key=lambda f: f[0])
    # UTF-8 in single bytes has the strictest structure: where it explains as much, it goes first.
    best = max((f for f in found if f[2] and f[1] >= best[1]), key=lambda f: f[0], default=best)
    out, at = [], 0
    for _, i, j, good in best[3]:
        out += [text[at:i], good]
        at = j
    return "".join([*out, text[at:]]), best[4]


def repair(text: str | None, logp: Likelihood) -> tuple[str | None, str] | None:
    """(restored text, how), or None for text in order.

    The restored text is None where bytes were lost and nothing could be decoded. Where only a part was
    lost the rest is restored and U+FFFD stays in its place. Null, empty and ASCII text is in order.
    """
    if not text or text.isascii():
        return None
    now, how, seen = text, [], {text}
    while True:  # level by level, as long as there is a text not seen before
        step = undo(now, logp)
        if step is None or (how and LOST in now and step[1].startswith("gb18030")):
            break  # what a lost byte leaves of a sequence is no GBK text
        if LOST in step[0] and step[0].count(LOST) > now.count(LOST):
            how.append("lost")
            break
        how.append(step[1])
        if step[0] in seen:
            break
        now = step[0]
        seen.add(now)
    if C1.search(now):
        fixed = C1.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "ignore") or m.group(), now)
        how.append("cp1252 via latin-1")
        now = fixed
    if LOST in now and "lost" not in how:
        how.append("lost")
    if not how:
        return None
    return (now if now != text else None), ", ".join(how)


def _whole(text: str, restored: str | None, how: str) -> bool:
    """Whether a reading explains more than stray characters: none beyond ASCII stays, all of them become Chinese, or UTF-8 came out of single bytes."""
    if restored is None:
        return False
    return not {c for c in text if not c.isascii()} & set(restored) or CHINESE.fullmatch(restored) is not None or set(how.split(", ")) <= STRICT


def judge(text: str, n: int, every: Likelihood, distinct: Likelihood) -> tuple[str | None, str] | None:
    """As :func:`repair`, for a value that stands in the table ``n`` times.

    ``every`` counts characters over all rows, ``distinct`` over distinct values. Judged as if it stood there once,
    or by distinct values, a value copied often looks rarer than its reading even if it is in order, so these views
    alone are believed only where the reading is whole.
    """
    once = repair(text, every.without(text, n - 1))
    if once is not None and (n == 1 or _whole(text, *once)):
        return once
    sure = repair(text, every) if n > 1 else None
    if sure is not None:
        return once or sure
    sure = repair(text, distinct)
    return sure if sure is not None and _whole(text, *sure) else None


def _familiar(chars: list[str], logp: Likelihood) -> float:
    new = [c for c in chars if not c.isascii()]
    return sum(logp.counts.get(c, 0) > 0 for c in new) / len(new) if new else 0.0


def _letters(text: str) -> bool:
    """Whether a single-byte reading looks like words: letters, mostly small ones, and everyday signs."""
    letters = [c for c in text if c.isalpha()]
    signs = [c for c in text if not c.isalpha() and not c.isascii()]
    return len(letters) >= 3 and not signs and sum(c.islower() for c in letters) >= 0.6 * len(letters)


def settle(text: str, restored: str | None, how: str, logp: Likelihood) -> tuple[str | None, str]:
    """The restored text, or None where GBK is only one of the encodings its bytes may have been.

    The structure of GBK fits the bytes of most double-byte encodings. A reading by GBK whose new characters are
    mostly unknown to all other values gives way to a rival whose characters are known, and to no text at all if
    there are only unknown rivals.
    """
    if restored is None or "gb18030" not in how or _familiar([c for c in restored if c not in set(text)], logp) >= FAMILIAR:
        return restored, how
    if "," in how:
        return None, f"{how}, uncertain"
    codec, rivals = how.split(" via ")[1], []
    found = spans(text, codec, "gb18030", GBK, logp)
    for rival in RIVALS:
        try:
            out, at = [], 0
            for _, i, j, _ in found:
                out += [text[at:i], b"".join(to_bytes(c, codec) for c in text[i:j]).decode(rival)]
                at = j
            rivals.append((_familiar([c for x in out[1::2] for c in x], logp), rival, "".join([*out, text[at:]])))
        except UnicodeDecodeError:
            continue
    parts = [to_bytes(c, codec) for c in text]  # a single-byte rival has to explain the whole text
    for rival in RIVAL_LETTERS if all(len(p) == 1 for p in parts) else ():
        read = b"".join(parts).decode(rival, "replace")
        if LOST not in read and _letters(read):
            rivals.append((_familiar(list(read), logp), rival, read))
    if not rivals:
        return restored, how
    best = max(rivals, key=lambda r: r[0])
    return (best[2], f"{best[1]} via {codec}") if best[0] >= FAMILIAR else (None, f"{how}, uncertain")


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """``text``, ``n``: each distinct value of ``fields`` but null and empty ones, and how often it stands there."""
    return df.select(F.explode(F.array(*fields)).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))


def char_counts(values: DataFrame) -> DataFrame:
    """Occurrences of each character in all values (``n``) and in distinct ones (``k``): at most one row for each code point of Unicode."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        distinct: Counter[str] = Counter()
        for b in batches:
            for text, n in zip(b["text"], b["n"]):
                for ch, k in Counter(text).items():
                    total[ch] += int(n) * k
                    distinct[ch] += k
        yield pd.DataFrame({"cp": [ord(c) for c in total], "n": list(total.values()), "k": [distinct[c] for c in total]})

    return values.mapInPandas(count, "cp int, n bigint, k bigint").groupBy("cp").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def find_garbled(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """One row for each garbled value: ``row_id``, ``field_name``, ``original``, ``restored``, ``how``.

    ``restored`` is null where nothing can be recovered or several readings are as good. Repeated rows come out as often as they came in;
    nulls, empty texts and an empty table give no rows. Texts are read whole.
    """
    spark = df.sparkSession
    values = Cuts(spark).cut(value_counts(df, fields))
    rows = char_counts(values).collect()  # bounded by the code points of Unicode
    shared = spark.sparkContext.broadcast(({chr(r.cp): r.n for r in rows}, {chr(r.cp): r.k for r in rows}))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, distinct = map(Likelihood, shared.value)
        for b in batches:
            got = [(text, judge(text, int(n), every, distinct)) for text, n in zip(b["text"], b["n"])]
            yield pd.DataFrame([(text, *settle(text, *g, every)) for text, g in got if g is not None], columns=["original", "restored", "how"])

    # Only values with a character beyond ASCII leave the JVM, each once, and are spread anew: judging is the larger part of the work.
    beyond = r"[^\x00-\x7F]"
    some = values.where(F.col("text").rlike(beyond)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "text")
    garbled = some.mapInPandas(find, "original string, restored string, how string")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(F.col(f).rlike(beyond), F.col(f)).alias("original")) for f in fields]))
    rows_ = df.select(F.col(row_id).alias("_rid"), each.alias("_v")).select("_rid", "_v.*").where("original IS NOT NULL")
    return rows_.join(garbled, "original").select(F.col("_rid").alias(row_id), "field_name", "original", "restored", "how")
