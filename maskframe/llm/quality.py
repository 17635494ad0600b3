"""Per-document text statistics, and a learned ordered rule list that tells prose from other matter.

Statistics are native expressions over whole texts, one pass without a shuffle. Rules are induced by
incremental reduced-error pruning on labelled documents (a bounded sample), each a conjunction of thresholds
on statistics, and exported as one SQL CASE expression that is applied natively to every document.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that rules are learned from, at most; of more, those with the least hash are taken.
MAX_LABELLED = 20_000
#: A rule is grown to at most so many conditions, a list to at most so many rules.
MAX_CONDITIONS, MAX_RULES = 6, 12
#: An accepted rule is right for most held-out rows it covers, has at least this precision (with Laplace's
#: correction) on all labelled rows not covered before, and covers at least this part of the positive ones:
#: rules that only explain wrong labels end the induction.
MIN_PRECISION, MIN_COVER = 0.8, 0.02
#: Random divisions into growing and pruning rows; the list with the fewest errors on all labelled rows is taken.
DIVISIONS = 5
#: Applies, with a warning and marked in :func:`rule_report`, where labels support no rule at all.
DEFAULT_RULES: list[list[tuple[str, str, float]]] = [[("prose_share", "<=", 0.5)]]

#: Characters and words that hold sentences together, by language; own choice, not fitted.
COMMON_CHARS = (
    "的了在是不就也把从到才都还和与用里得这那要再会可因所以而且着被让给对一每只很时上下看有"
    "のはがをにでとてたしるれもへやかならです"
    "은는을를의에로와과도고다"
)
COMMON_WORDS = (
    "the a an of to and in is was that it for on with as at by be this from or but not are were had have its so then one they you i we he she after before what when if no only would could because which who there their my our your "
    "der die das und ist nicht ein eine zu den mit von auf für sich auch es im dem wird "
    "le la les des et est un une dans pour que qui pas sur avec ce il au du ne "
    "el los las y es una por con para no se del al lo como más su "
    "il di che è non per con sono della del una si come anche "
    "o os as e é um uma do da em não por com para se na no que "
    "het een van en niet dat zijn op te met voor ook "
    "и в не на что с по как это к но из у за от для"
)
MARKER = r"\A\s*(?:[-*+•·◦○●▪■□]\s|[（(]?[0-9]{1,3}[.)、）:：]\s*(?=\D)|[（(]?[a-zA-Z一二三四五六七八九十]{1,2}[.)、）]\s|\[[ xX]?\])"
ENDS = "[.!?。！？…;；:：,，]"
MARK = "\x01"
LETTER = "a-zA-ZÀ-ɏЀ-ӿ"
#: In the order in which equally good conditions are tried.
STATS = [
    "prose_share", "common_share", "repeat_share", "tabular_share", "marker_share", "symbol_ratio", "digit_ratio",
    "long_token_share", "short_line_share", "end_punctuation", "sentence_density", "mean_word_length", "words"
]


def _trie(words: list[str]) -> str:
    """One alternation that shares prefixes, so that a position fails on its first letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    tail = [f"{h}{_trie(rest)}" for h, rest in sorted(heads.items()) if h]
    inner = "|".join(tail)
    return "" if not tail else f"(?:{inner})" + ("?+" if "" in heads else "")


def _word_pattern() -> str:
    spelt = {f(w) for w in COMMON_WORDS.split() for f in (str, str.capitalize, str.upper)}
    return f"(?=[{LETTER}])(?<![0-9{LETTER}]){_trie(sorted(spelt))}(?![0-9{LETTER}])"


def _sum(pieces: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda acc, x: acc + of(x))


def _times(c: Column, what: str) -> Column:
    """Occurrences of one character."""
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def _tabular(x: Column) -> Column:
    """A line of cells: pipes, tabs, tags, wide gaps, key-value pairs, or commas without blanks between short cells."""
    commas = _times(x, ",")
    return (
        (_times(x, "|") >= 2) | (_times(x, "\t") >= 2) | F.contains(x, F.lit("<td")) | F.contains(x, F.lit("<tr"))
        | F.contains(F.trim(x), F.lit("   ")) | ((_times(x, "=") >= 2) & F.contains(x, F.lit("; ")))
        | ((commas >= 2) & (F.length(x) <= 16 * (commas + 1)) & ~F.contains(x, F.lit(", ")))
    )


def _removed(c: str, pattern: str) -> Column:
    """Characters of ``c`` in the matches of ``pattern``."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns ``STATS`` for every row.

    Shares are of the text's characters but for ``end_punctuation`` (of its lines) and ``common_share``,
    ``sentence_density`` (per word or ideograph). Null and empty texts have zeros; repeated rows come out
    as often as they came in. Common words are first replaced by one mark each; lines and sentences are cut
    from that, so that counting them needs no further pattern.
    """
    wide = "".join(chr(a + i) for a in (0xFF21, 0xFF41) for i in range(26))  # full-width letters
    t = F.translate(F.coalesce(F.col(text), F.lit("")), wide + MARK, ascii_uppercase + ascii_lowercase + " ")
    d = docs.select(doc_id, t.alias("_t"))
    marks = F.regexp_replace(F.translate("_t", COMMON_CHARS, MARK * len(COMMON_CHARS)), _word_pattern(), MARK)
    d = d.select(doc_id, "_t", F.length("_t").alias("_n"), marks.alias("_m"), F.regexp_replace("_t", r"[a-zA-ZÀ-ɏͰ-ԯ]+", MARK).alias("_w"))
    d = d.select(
        "*", F.regexp_replace("_w", r"[㐀-鿿぀-ヿ가-힯]+", "").alias("_h"),
        F.filter(F.split("_m", r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0).alias("_lines")
    )
    feature = lambda x: F.struct(
        x.alias("x"), F.length(x).alias("n"), x.rlike(MARKER).alias("m"), _tabular(x).alias("t"),
        F.substring(F.rtrim(x), -3, 3).rlike(ENDS).alias("e")
    )
    d = d.select(
        doc_id, "_n", F.transform("_lines", feature).alias("_l"),
        _times(F.col("_m"), MARK).alias("_common"), _times(F.col("_w"), MARK).alias("_words"),
        F.length("_w").alias("_wn"), F.length("_h").alias("_hn"),
        _removed("_h", "[0-9]+").alias("_digits"), _removed("_h", r"[\s\x01]+").alias("_blank"),
        _removed("_t", r"(?<!\S)[\x21-\x7e]{25,}+(?!\S)").alias("_long"),
    )
    # Sentences of the lines that are neither items nor table rows; each counts once however often it stands there.
    running = F.concat_ws("\n", F.transform(F.filter("_l", lambda x: ~x["m"] & ~x["t"]), lambda x: x["x"]))
    for end in ("。", "！", "？"):
        running = F.replace(running, F.lit(end), F.lit(end + "\n"))
    for end in (". ", "! ", "? "):
        running = F.replace(running, F.lit(end), F.lit(end + "\n"))
    d = d.select("*", F.filter(F.split(running, "\n"), lambda x: F.length(F.trim(x)) > 0).alias("_p"))
    d = d.select("*", F.array_distinct("_p").alias("_d"))
    prose = _sum(F.col("_d"), lambda x: F.when((F.length(x) >= 6) & (_times(x, MARK) >= 0.05 * F.length(x)), F.length(x)).otherwise(0))
    n, flat = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.aggregate("_l", F.lit(0), lambda acc, x: acc + x["n"]), F.lit(1))
    letters, han = F.col("_n") - F.col("_wn") + F.col("_words"), F.col("_wn") - F.col("_hn")
    units = F.greatest(han + F.col("_words"), F.lit(1))
    by = lambda f: F.aggregate("_l", F.lit(0), lambda acc, x: acc + F.when(f(x), x["n"]).otherwise(0))
    return d.select(
        doc_id,
        (han + F.col("_words")).cast("double").alias("words"),
        (letters / F.greatest("_words", F.lit(1))).alias("mean_word_length"),
        ((F.col("_hn") - F.col("_digits") - F.col("_blank")) / n).alias("symbol_ratio"),
        (F.col("_digits") / n).alias("digit_ratio"),
        (F.size(F.filter("_l", lambda x: x["e"])) / F.greatest(F.size("_l"), F.lit(1))).alias("end_punctuation"),
        (F.col("_common") / units).alias("common_share"),
        (F.size("_p") / units).alias("sentence_density"),
        (by(lambda x: x["m"]) / flat).alias("marker_share"),
        (by(lambda x: x["t"]) / flat).alias("tabular_share"),
        (1 - _sum(F.col("_d"), F.length) / F.greatest(_sum(F.col("_p"), F.length), F.lit(1))).alias("repeat_share"),
        (F.col("_long") / n).alias("long_token_share"),
        (by(lambda x: (x["n"] < 24) & ~x["e"]) / flat).alias("short_line_share"),
        F.least(prose / flat, F.lit(1.0)).alias("prose_share"),
    )


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, op, v in rule:
        c = x[:, names.index(f)]
        hit &= c <= v if op == "<=" else c > v
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """Add the condition of greatest information gain until no negative row is covered."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        if not p0:
            break
        best: tuple[float, tuple | None, np.ndarray | None] = (1e-9, None, None)
        for k, f in enumerate(names):
            c = x[inside, k]
            order = np.argsort(c, kind="stable")
            v, pos = c[order], y[inside][order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            p_lo, n_lo = np.cumsum(pos)[ends], np.cumsum(~pos)[ends]
            for op, p, n in (("<=", p_lo, n_lo), (">", p0 - p_lo, n0 - n_lo)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-12:
                    at = float((v[ends[i]] + v[ends[i] + 1]) / 2)
                    best = (float(gain[i]), (f, op, at), x[:, k] <= at if op == "<=" else x[:, k] > at)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[2]
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[Rule, float, int]:
    """Drop closing conditions while the worth (p - n) / (p + n) on held-out rows does not fall."""
    best: tuple[Rule, float, int] = ([], -1.0, 0)
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], x, names)
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best[1]:
            best = (rule[:k], worth, p)
    return best


def _one_list(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator) -> list[Rule]:
    """Incremental reduced-error pruning under one series of random divisions: two thirds grow, one third prunes."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        at = {c: rng.permutation(np.flatnonzero(left & (y == c))) for c in (True, False)}
        if min(map(len, at.values())) < 3:
            break
        grow = np.concatenate([i[: (2 * len(i) + 2) // 3] for i in at.values()])
        keep = np.concatenate([i[(2 * len(i) + 2) // 3 :] for i in at.values()])
        rule, worth, _ = _prune(_grow(x[grow], y[grow], names), x[keep], y[keep], names)
        hit = _covers(rule, x, names)
        p, n = int(y[hit & left].sum()), int((~y[hit & left]).sum())
        if not rule or worth <= 0 or (p + 1) / (p + n + 2) < MIN_PRECISION or p < max(3, MIN_COVER * y.sum()):
            break
        for k in range(len(rule) - 1, 0, -1):  # later conditions that change nothing, the last one first
            fewer = rule[:k] + rule[k + 1 :]
            if (_covers(fewer, x, names) == hit).all():
                rule = fewer
        rules.append(rule)
        left &= ~hit
    return rules


def covered(rules: list[Rule], x: np.ndarray, names: list[str] = STATS) -> np.ndarray:
    """Rows that any of the rules covers."""
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= _covers(r, x, names)
    return hit


def induce(x: np.ndarray, y: np.ndarray, names: list[str] = STATS, seed: int = 0) -> list[Rule]:
    """Ordered rules for ``y``; of ``DIVISIONS`` lists the one with the fewest errors, then conditions. No rule where labels support none."""
    lists = [_one_list(x, y, names, np.random.default_rng([seed, k])) for k in range(DIVISIONS)]
    return min(lists, key=lambda rules: (int((covered(rules, x, names) != y).sum()), sum(map(len, rules))))


def held_out_f1(x: np.ndarray, y: np.ndarray, names: list[str] = STATS, folds: int = 5, seed: int = 0) -> float | None:
    """F1 of lists induced without a fold on that fold, over all folds; None without a positive row."""
    fold, guess = np.random.default_rng(seed).permutation(len(x)) % folds, np.zeros(len(x), bool)
    for k in range(folds):
        guess[fold == k] = covered(induce(x[fold != k], y[fold != k], names, seed), x[fold == k], names)
    both = int((guess & y).sum())
    return 2 * both / int(guess.sum() + y.sum()) if y.any() else None


def rules_sql(rules: list[Rule], then: str = "true", otherwise: str = "false") -> str:
    """The ordered list as one CASE expression over the statistics' columns."""
    whens = " ".join("WHEN " + " AND ".join(f"{f} {op} {v!r}D" for f, op, v in r) + f" THEN {then}" for r in rules)
    return f"CASE {whens} ELSE {otherwise} END"


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, kind: str = "kind", prose: str = "prose"
) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and sides (other matter or not) of at most ``MAX_LABELLED`` labelled documents."""
    some = labels.where(F.col(kind).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, (F.lower(F.trim(kind)) != prose).alias("_y"))
    some = some.orderBy(F.xxhash64(doc_id), "_y").limit(MAX_LABELLED)
    # The limit bounds the broadcast: the labels travel to the documents, whose texts are not shuffled.
    found = docs.select(doc_id, text).join(F.broadcast(some), doc_id)
    stats = statistics(found.select(F.struct(doc_id, "_y").alias("_k"), text), "_k", text)
    rows = stats.select("_k.*", *STATS).toPandas().sort_values([doc_id, "_y"], kind="stable")
    return rows[STATS].to_numpy(float).reshape(-1, len(STATS)), rows["_y"].to_numpy(bool)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[list[Rule], bool]:
    """Rules for what is not prose, and whether the labels gave them; the default ones, with a warning, where they support none."""
    rules = induce(*labelled_statistics(docs, labels, doc_id, text))
    if not rules:
        warnings.warn("the labels support no rule; the default rule is applied", stacklevel=2)
    return rules or [list(r) for r in DEFAULT_RULES], bool(rules)


def rule_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each rule: ``place``, ``rule``, ``origin`` (learned or default), labelled rows ``covered``, ``precision`` on them, and the list's ``held_out_f1``."""
    x, y = labelled_statistics(docs, labels, doc_id, text)
    rules = induce(x, y)
    origin, f1, rows, left = "learned" if rules else "default", held_out_f1(x, y), [], np.ones(len(x), bool)
    for k, r in enumerate(rules or DEFAULT_RULES, 1):
        hit = _covers(r, x, STATS) & left
        rows.append((
            k, " AND ".join(f"{f} {op} {v:.6g}" for f, op, v in r), origin, int(hit.sum()),
            round(float(y[hit].mean()), 6) if hit.any() else None, None if f1 is None else round(f1, 6)
        ))
        left &= ~hit
    return docs.sparkSession.createDataFrame(rows, "place int, rule string, origin string, covered bigint, precision double, held_out_f1 double")


def not_prose(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` of every document that the learned rules take for other matter than prose.

    Labels without a document are left out; of several labels of a document each counts. Empty texts are
    other matter under the default rules.
    """
    rules, _ = learn(docs, labels, doc_id, text)
    stats = statistics(docs, doc_id, text)
    # One-element explode: the statistics are computed once a row, below the CASE that filters on them.
    rows = stats.select(doc_id, F.explode(F.array(F.struct(*STATS))).alias("_s")).select(doc_id, "_s.*")
    return rows.where(F.expr(rules_sql(rules))).select(doc_id)
