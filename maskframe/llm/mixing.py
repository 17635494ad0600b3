"""Mixing sources to target weights by soft membership.

A document's membership in the domains of the targets is its source where that is named. Where it is not, a
classifier predicts it from the text: a labelled table of token, language and style counts by domain (naive
Bayes over named documents, from which the name itself is held out), with a temperature chosen on held-out
documents so that the posteriors are as sure as they are right. Nonnegative rates of the documents are fitted
by projected gradient descent on the squared error of expected domain token totals; documents of equal
membership form a cell, each step is one distributed sum over cells, and rates are the replayed steps, so no
lineage grows. Memberships stay soft to the end: shares are reported by source and in expectation. Rates become
whole repeats by a cut through the documents' hash order at the right token total.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.text import strip
from maskframe.plans.checkpoints import Cuts

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Word pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = "(other)"
#: Named documents the classifier is fitted on, about so many of each domain (those of least hash); a fifth is held out.
LABELLED = 2_000
SMOOTHING = 0.5
TEMPERATURES = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0]
#: Posteriors are kept to a hundredth.
GRAIN = 100
#: Steps of the fit at most, and the share error at which it ends.
MAX_STEPS, TOLERANCE = 80, 1e-5
#: Totals tried at once, as parts of the largest that every domain could reach by itself.
TOTALS = [1.0, 0.97, 0.94, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5]
BUCKETS = 65536

_ENCODERS: dict[str, object] = {}


class Tokenizer:
    """A byte-level vocabulary whose file is read once, by the driver, and travels as bytes; built once in each worker."""

    def __init__(self, spark, path: str):
        self.path, self.shared = path, spark.sparkContext.broadcast(Path(path).read_bytes())

    def encoder(self):
        enc = _ENCODERS.get(self.path)
        if enc is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.shared.value.splitlines() if x)}
            enc = _ENCODERS[self.path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return enc

    def __getstate__(self):
        return {"path": self.path, "shared": self.shared}

    def count(self):
        """Pandas function: tokens of each text; null has none."""

        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            enc = self.encoder()
            for texts in batches:
                yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

        count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(count, "bigint")


def source_name(c: Column) -> Column:
    """Plain spelling of a source: lower case, words joined by ``_``; empty for null and blank."""
    return F.coalesce(F.regexp_replace(F.lower(strip(c)), r"[-\s_]+", "_"), F.lit(""))


def features(docs: DataFrame, domains: list[str]) -> DataFrame:
    """``doc_id``, ``name`` (the plain source), ``label`` (its domain; null without a name), ``text``, ``lang``, ``style``."""
    name = source_name(F.col("source"))
    label = F.when(name == "", None).when(name.isin(domains), name).otherwise(OTHER)
    lang = F.coalesce(F.substring(F.lower(strip(F.col("lang"))), 1, 2), F.lit(""))
    return docs.select(
        "doc_id", name.alias("name"), label.alias("label"), "text", lang.alias("lang"),
        F.coalesce("style_id", F.lit("")).alias("style")
    )


def _seen(enc, text: str | None, lang: str, style: str) -> tuple[dict, int]:
    tokens = enc.encode_ordinary(text) if text else []
    return {**Counter(map(str, tokens)), f"lang {lang}": 1, f"style {style}": 1}, len(tokens)


class Classifier:
    """Naive Bayes from the labelled table; ``temperature`` flattens posteriors that dependent features make too sure."""

    def __init__(self, domains: list[str], counts: pd.DataFrame, docs: dict[str, int]):
        self.domains, self.temperature = domains, 1.0
        at = {d: i for i, d in enumerate(domains)}
        names = {f: i for i, f in enumerate(sorted(set(counts["feature"])))}
        table = np.full((len(names) + 1, len(domains)), SMOOTHING)
        np.add.at(table, (counts["feature"].map(names).to_numpy(int), counts["domain"].map(at).to_numpy(int)), counts["n"].to_numpy(float))
        self.names, self.weight = names, np.log(table / table.sum(axis=0))
        self.prior = np.log(np.array([docs.get(d, 0) + SMOOTHING for d in domains]))

    def scores(self, seen: dict) -> np.ndarray:
        rows = np.fromiter((self.names.get(f, len(self.names)) for f in seen), int, len(seen))
        return np.fromiter(seen.values(), float, len(seen)) @ self.weight[rows]

    def posterior(self, scores: np.ndarray, temperature: float | None = None) -> np.ndarray:
        s = self.prior + scores / (temperature or self.temperature)
        e = np.exp(s - s.max())
        return e / e.sum()


def fit_classifier(feats: DataFrame, domains: list[str], sizes: dict[str, int], tok: Tokenizer) -> tuple[Classifier, float]:
    """The classifier, fitted on about ``LABELLED`` named documents of each domain, and its accuracy on the held-out fifth."""
    spark = feats.sparkSession
    part = F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(LABELLED / max(sizes.get(d, 0), 1)))])
    some = feats.where(F.col("label").isNotNull()).where(part < F.element_at(share, F.col("label")))
    some = some.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, total = tok.encoder(), Counter()
        for b in batches:
            for text, label, lang, style in zip(b["text"], b["label"], b["lang"], b["style"]):
                for f, n in _seen(enc, text, lang, style)[0].items():
                    total[label, f] += n
        yield pd.DataFrame([(d, f, n) for (d, f), n in total.items()], columns=["domain", "feature", "n"])

    table = some.where("NOT held").select("text", "label", "lang", "style").mapInPandas(count, "domain string, feature string, n bigint")
    table = table.groupBy("domain", "feature").agg(F.sum("n").alias("n"))  # at most domains times the vocabulary
    model = Classifier(domains, table.toPandas(), sizes)
    shared = spark.sparkContext.broadcast(model)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, m = tok.encoder(), shared.value
        loss, hit, docs = np.zeros(len(TEMPERATURES)), np.zeros(len(TEMPERATURES)), 0
        for b in batches:
            for text, label, lang, style in zip(b["text"], b["label"], b["lang"], b["style"]):
                s, k = m.scores(_seen(enc, text, lang, style)[0]), m.domains.index(label)
                for i, t in enumerate(TEMPERATURES):
                    p = m.posterior(s, t)
                    loss[i] -= np.log(max(p[k], 1e-12))
                    hit[i] += p.argmax() == k
                docs += 1
        yield pd.DataFrame({"i": range(len(TEMPERATURES)), "loss": loss, "hit": hit, "docs": docs})

    judged = some.where("held").select("text", "label", "lang", "style").mapInPandas(test, "i int, loss double, hit double, docs bigint")
    rows = judged.groupBy("i").agg(
        F.sum("loss").alias("loss"), F.sum("hit").alias("hit"), F.sum("docs").alias("docs")
    ).collect()  # a row for each temperature
    best = min(rows, key=lambda r: (r.loss, r.i), default=None)
    if best is None or not best.docs:
        return model, 0.0
    model.temperature = TEMPERATURES[best.i]
    return model, best.hit / best.docs


def soft_members(feats: DataFrame, model: Classifier, tok: Tokenizer) -> DataFrame:
    """``doc_id``, ``tokens``, ``q`` of documents without a name: posteriors by domain in whole ``1 / GRAIN`` parts."""
    shared = feats.sparkSession.sparkContext.broadcast(model)
    kind = feats.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, m = tok.encoder(), shared.value
        for b in batches:
            rows = []
            for d, text, lang, style in zip(b["doc_id"], b["text"], b["lang"], b["style"]):
                seen, n = _seen(enc, text, lang, style)
                rows.append((d, n, np.rint(m.posterior(m.scores(seen)) * GRAIN).astype(int).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "tokens", "q"])

    return feats.where("label IS NULL").select("doc_id", "text", "lang", "style").mapInPandas(judge, f"doc_id {kind}, tokens bigint, q array<int>")


class Fit:
    """Projected gradient descent, with momentum, on expected domain totals; several totals of the mixture at once.

    Cells are rows ``tokens``, ``q`` (membership parts, the last one for no target) and ``cap``. With ``have`` the
    tokens expected in each domain, the squared error weighted by ``1 / have`` has curvature one at most in the
    metric of the cells' tokens, so the step is one and projection onto ``[0, cap]`` is exact cell by cell.
    """

    def __init__(self, cells: DataFrame, shares: list[float], total: float | None = None):
        self.cells, n = cells.select("tokens", "q", "cap"), len(shares)
        p = lambda i: F.col("tokens") * F.col("q")[i] / F.aggregate("q", F.lit(0), lambda a, x: a + x)
        sums = cells.agg(*[F.sum(p(i)).alias(f"a{i}") for i in range(n)], *[F.sum(F.col("cap") * p(i)).alias(f"c{i}") for i in range(n)]).first()
        self.have = np.array([float(sums[f"a{i}"] or 0) for i in range(n)])
        most = np.array([float(sums[f"c{i}"] or 0) for i in range(n)])
        self.live = (self.have > 0) & (most > 0) & (np.array(shares) > 0)
        want = np.where(self.live, shares, 0.0)
        self.want = want / (want.sum() or 1.0)
        top = min((most[self.live] / self.want[self.live]).tolist(), default=0.0)
        self.totals = np.array([total] if total is not None else [top * t for t in TOTALS])
        self.steps: list[tuple[np.ndarray, float]] = []
        self.errors: list[np.ndarray] = []
        self.chosen = 0

    def replay(self, q: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after the steps so far and the points of the next gradient, for each total and cell."""
        p = q[:, : len(self.want)] / np.maximum(q.sum(axis=1, keepdims=True), 1)
        r = y = np.repeat(np.minimum(cap, 1.0)[None, :], len(self.totals), axis=0)
        for g, beta in self.steps:
            new = np.clip(y - g @ p.T, 0.0, cap)
            r, y = new, new + beta * (new - r)
        return r, y

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Expected domain totals at the rates and at the gradient's points: one distributed sum."""
        shape = (len(self.totals), len(self.want))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at_r, at_y = np.zeros(shape), np.zeros(shape)
            for b in batches:
                if len(b):
                    q, cap, tokens = np.array(b["q"].tolist(), float), b["cap"].to_numpy(float), b["tokens"].to_numpy(float)
                    r, y = self.replay(q, cap)
                    p = q[:, : shape[1]] / np.maximum(q.sum(axis=1, keepdims=True), 1)
                    at_r += (r * tokens) @ p
                    at_y += (y * tokens) @ p
            yield pd.DataFrame({"k": range(shape[0] * shape[1]), "r": at_r.ravel(), "y": at_y.ravel()})

        rows = self.cells.mapInPandas(part, "k int, r double, y double").groupBy("k").agg(
            F.sum("r").alias("r"), F.sum("y").alias("y")
        ).collect()  # totals times domains
        out = np.zeros((2, shape[0] * shape[1]))
        for r in rows:
            out[:, r.k] = r.r, r.y
        return out[0].reshape(shape), out[1].reshape(shape)

    def run(self) -> Fit:
        """Steps until the largest total is met, or no larger one than the first met can still be; at most ``MAX_STEPS``."""
        if not self.live.any() or not (self.totals > 0).all():
            return self
        t = 1.0
        for _ in range(MAX_STEPS):
            at_r, at_y = self._sums()
            error = np.abs(at_r / self.totals[:, None] - self.want).max(axis=1)
            self.errors.append(error)
            met = np.flatnonzero(error <= TOLERANCE)
            first = met[0] if len(met) else len(error)
            stuck = len(self.errors) > 10 and (self.errors[-11] - error < 0.05 * self.errors[-11])[:first].all()
            if first == 0 or stuck:
                break
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            off = np.where(self.live, at_y - self.totals[:, None] * self.want, 0.0) / np.where(self.live, self.have, 1.0)
            self.steps.append((off, 0.0 if len(self.steps) == 0 else (t - 1) / later))
            t = later
        error = self.errors[-1]
        met = np.flatnonzero(error <= max(TOLERANCE, 1e-3))
        self.chosen = int(met[0] if len(met) else error.argmin())
        return self

    def rates(self) -> DataFrame:
        """``q``, ``cap``, ``rate`` of every cell at the chosen total."""

        def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b[["q", "cap"]].assign(rate=self.replay(np.array(b["q"].tolist(), float), b["cap"].to_numpy(float))[0][self.chosen])

        return self.cells.select("q", "cap").mapInPandas(rate, "q array<int>, cap double, rate double")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cells"}


def _whole(used: DataFrame, cuts: Cuts) -> DataFrame:
    """``used`` (``source, cap, rate, tokens``, ...) with ``repeats``, whole numbers whose token total is that of the rates.

    Documents of one source, cap and rate (to a thousandth; their token-weighted mean then holds for all) form a
    group, at most a few ten thousand of them. In hash order those before the group's cut get one repeat more
    than the rest; only the bucket the cut falls into is put in order.
    """
    group = ["source", "cap", "_near"]
    u = used.where("rate > 0 AND tokens > 0").withColumn("_near", F.round(F.log("rate") * 1000).cast("int"))
    u = u.withColumn("_h", F.xxhash64("doc_id")).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    buckets = cuts.cut(u.groupBy(*group, "_b").agg(
        F.sum("tokens").alias("w"), F.sum(F.col("rate") * F.col("tokens")).alias("rw"), F.min("rate").alias("lo"),
        F.max("rate").alias("hi")
    ))
    mean = buckets.groupBy(*group).agg(
        F.greatest(F.least(F.sum("rw") / F.sum("w"), F.max("hi")), F.min("lo")).alias("_rate"), F.sum("w").alias("_all")
    )
    before = F.coalesce(
        F.sum("w").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )  # at most BUCKETS rows each
    goal = F.col("_all") * (F.col("_rate") - F.floor("_rate"))
    ends = buckets.withColumn("_before", before).join(F.broadcast(mean), group).where(F.col("_before") + F.col("w") > goal)
    cut = ends.groupBy(*group).agg(F.min_by(
        F.struct(F.col("_b").alias("edge"), F.col("_before").alias("before"), F.col("_rate").alias("rate"), goal.alias("goal")),
        "_b"
    ).alias("_c"))
    cut = cuts.cut(cut)  # written, as a sum's last digits change from run to run
    u = u.drop("rate").join(F.broadcast(cut), group)
    inside = F.sum("tokens").over(Window.partitionBy(*group).orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    plain = u.where("_b <> _c.edge").withColumn("_more", F.col("_b") < F.col("_c.edge"))
    # The document on the cut is taken with the chance of its part before it, so groups of one are right on average.
    chance = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / F.lit(1 << 20)
    close = u.where("_b = _c.edge").withColumn("_upto", F.col("_c.before") + inside).withColumn(
        "_more", F.col("_upto") - F.col("tokens") * chance <= F.col("_c.goal")
    ).drop("_upto")
    done = plain.unionByName(close).withColumn("repeats", (F.floor("_c.rate") + F.when(F.col("_more"), 1).otherwise(0)).cast("int"))
    return done.where("repeats > 0").drop(*group[1:], "_h", "_b", "_c", "_more")


class Mixture:
    """The mixture and how it came about: ``rows``, ``fit``, ``accuracy`` of the classifier (null where none was needed)."""

    def __init__(self, rows: DataFrame, fit: Fit | None = None, accuracy: float | None = None):
        self.rows, self.fit, self.accuracy = rows, fit, accuracy


def mix(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, total: float | None = None) -> Mixture:
    """Rows ``doc_id``, ``source``, ``tokens``, ``repeats``, ``p`` for every document used.

    ``source`` is the named one, else the likeliest; ``p`` is the membership in the targets, in order of their
    plain names. No document is used more often than the least ``max_repeats`` of the targets it may belong to;
    documents of named sources without a target and texts without tokens are not used. Targets with null shares
    count as zero, of repeated targets the largest holds; targets without documents leave their share to the
    others. An empty corpus, one without any named source, and no targets give no rows. Repeated rows are documents of their own; null texts
    have no tokens, null languages and styles are values of their own; other columns do not matter.
    """
    spark = docs.sparkSession
    t = targets.select(
        source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")
    )
    t = t.where("source <> ''").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    domains = [r.asDict() for r in t.orderBy("source").collect()]  # the stated targets
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not domains:
        return Mixture(spark.createDataFrame([], f"doc_id {kind}, source string, tokens bigint, repeats int, p array<double>"))
    names = [d["source"] for d in domains]
    tok, cuts = Tokenizer(spark, path), Cuts(spark)
    feats = features(docs, names)
    hot = F.array(*[F.when(F.col("label") == n, GRAIN).otherwise(0) for n in [*names, OTHER]])
    named = feats.where(F.col("label").isin(names)).select("doc_id", tok.count()("text").alias("tokens"), hot.alias("q"), F.lit(True).alias("named"))
    sizes = {r.label: r.n for r in feats.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each target
    accuracy, every = None, named
    if sizes.get(None) and len(sizes) > 1:
        model, accuracy = fit_classifier(feats, [*names, OTHER], sizes, tok)
        every = named.unionByName(soft_members(feats, model, tok).withColumn("named", F.lit(False)))
    most = F.array(*[F.lit(float(d["max_repeats"])) for d in domains])
    mine = F.slice("q", 1, len(names))
    cap = F.array_min(F.filter(F.zip_with(mine, most, lambda q, m: F.when(q > 0, m)), lambda m: m.isNotNull()))
    counted = cuts.cut(every.where(F.exists(mine, lambda q: q > 0)).withColumn("cap", cap))
    cells = cuts.cut(counted.groupBy("q", "cap", "named").agg(F.sum("tokens").alias("tokens")).where("cap > 0 AND tokens > 0"))
    fit = Fit(cells, [d["target_share"] for d in domains], total).run()
    rates = cuts.cut(fit.rates().distinct())
    # Named documents have one membership for each target: those rates are a few rows and go to every task.
    few = F.broadcast(rates.where(F.exists("q", lambda q: q == GRAIN)).where(F.expr(f"aggregate(q, 0, (a, x) -> a + x) = {GRAIN}")))
    rated = counted.where("named").join(few, ["q", "cap"]).unionByName(counted.where("NOT named").join(rates, ["q", "cap"]))
    whole = F.aggregate("q", F.lit(0), lambda a, x: a + x)
    p = F.transform(mine, lambda q: q / whole)
    top = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(mine, F.array_max(mine)).cast("int"))
    used = rated.select("doc_id", top.alias("source"), "cap", "rate", "tokens", p.alias("p"))
    return Mixture(_whole(used, cuts).select("doc_id", "source", "tokens", "repeats", "p"), fit, accuracy)


def mixture(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, total: float | None = None) -> DataFrame:
    """The rows of :func:`mix`."""
    return mix(docs, targets, path, total).rows


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents and tokens used, with repeats, the most repeats of a document, the actual share and the one expected under the memberships."""
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    size = F.col("tokens") * F.col("repeats")
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(size).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    names = t.where("source <> ''").select("source").distinct().agg(F.array_sort(F.collect_list("source")).alias("_names"))  # the stated targets
    parts = mixed.select(
        size.alias("size"), F.posexplode("p").alias("i", "part")
    ).groupBy("i").agg(F.sum(F.col("size") * F.col("part")).alias("expected"))
    parts = parts.crossJoin(F.broadcast(names)).select(F.col("_names")[F.col("i")].alias("source"), "expected")  # one row
    total = got.agg(F.sum("tokens_used").alias("all"))
    j = t.join(got, "source", "left").join(parts, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("all"), 6)
    return j.select(
        "source", "target_share", "max_repeats", zero("docs"), zero("tokens_used"), zero("most_repeats"),
        share("tokens_used").alias("actual_share"), share("expected").alias("expected_share")
    )
