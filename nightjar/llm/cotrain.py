"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Each view is a logistic model over binned features. The text view's are numbers that describe the text and the evidence
of its words and word pairs: these are hashed to ``GRAMS`` places, every place has the log ratio of its frequency in good
and in bad documents, and a text has the mean over its places. For documents that the ratios were counted on, the
evidence comes from ratios counted without their fold. Both views start from the labelled sample; in every round each
gives the other its confident pseudo-labels on an unlabelled pool, where its confidence has held on a calibration
fold. The views are then calibrated on that fold, combined there, and the combination scores every document in one
pass, without moving a text.

The fit reads bounded samples only: at most ``labelled`` labelled rows and ``pool`` unlabelled ones, both chosen by
a hash of the id. Everything else covers all rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.sim_blocks import with_previous, word_hashes

LABELLED, POOL, ROUNDS, BINS, CATEGORIES = 20_000, 20_000, 3, 12, 64
CONFIDENT, TRUSTED, THRESHOLD, SEED = 0.97, 0.95, 0.5, 11
GRAM_BITS, FOLDS = 11, 5
GRAMS = 1 << GRAM_BITS
_NUMBERS, _NAMES = ("m_chars",), ("m_source", "m_lang")
_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def grams(text: str | None) -> np.ndarray:
    """Which of the GRAMS places the words and pairs of neighbouring words of a whole text fall on."""
    found, _ = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"), _WORD)
    held = np.zeros(GRAMS, bool)
    for hashes in (found, with_previous(found, np.array([len(found)]))):
        held[hashes >> np.uint64(64 - GRAM_BITS)] = True
    return held


@F.arrow_udf(T.BinaryType())
def gram_bits(text: pa.Array) -> pa.Array:
    """The places of `grams` as a bitset of fixed size."""
    return pa.array([np.packbits(grams(t.as_py())).tobytes() for t in text], pa.binary())


def evidence_of(ratios: np.ndarray) -> Column:
    """A function of a text column: its mean log ratio."""

    @F.arrow_udf(T.DoubleType())
    def mean(text: pa.Array) -> pa.Array:
        held = (grams(t.as_py()) for t in text)
        return pa.array([float(ratios[h].mean()) if h.any() else 0.0 for h in held], pa.float64())

    return mean


def _blocks(packed: np.ndarray, size: int = 1024):
    """(first row, the rows' places as numbers) in blocks: only the bitsets of the whole sample are held, GRAMS / 8 bytes a row."""
    for i in range(0, len(packed), size):
        yield i, np.unpackbits(packed[i : i + size], axis=1).astype(np.float32)


def fold_counts(packed: np.ndarray, y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each fold and label have each place, and how many rows there are; rows without a label don't count."""
    group = np.where(np.isnan(y), -1, part * 2 + np.nan_to_num(y)).astype(np.int64)
    counts = np.zeros((FOLDS * 2, GRAMS))
    for i, bits in _blocks(packed):
        counts += (group[i : i + len(bits)] == np.arange(FOLDS * 2)[:, None]).astype(np.float32) @ bits
    return counts.reshape(FOLDS, 2, GRAMS), np.bincount(group[group >= 0], minlength=FOLDS * 2).reshape(FOLDS, 2)


def log_ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The log ratio of each place's frequency in rows of label 1 and of label 0, smoothed by one row."""
    return np.log((counts[1] + 1) / (rows[1] + 2)) - np.log((counts[0] + 1) / (rows[0] + 2))


def evidence(packed: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The mean ratio over each row's places."""
    out = np.zeros(len(packed))
    for i, bits in _blocks(packed):
        out[i : i + len(bits)] = bits @ ratios.astype(np.float32) / np.maximum(bits.sum(axis=1), 1)
    return out


def text_view(text: Column) -> dict[str, Column]:
    """Numbers that describe a text's content; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n, nw = F.greatest(F.length(text), F.lit(1)).cast("double"), F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "t_words": F.log1p(nw),
        "t_word_length": n / nw,
        "t_distinct_words": F.size(F.array_distinct(words)) / nw,
        "t_distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "t_words_a_line": F.log1p(nw / F.size(lines)),
        "t_capitals": count("[A-Z]") / n,
        "t_digits": count("[0-9]") / n,
        "t_stops": count("[.?]") / nw,
        "t_commas": count("[,;:]") / nw,
        "t_bangs": count("!") / nw,
        "t_bars": count(r"[|<>{}\[\]=_~^\\/]") / nw,
        "t_symbols": count(r"[#$%&*@+]") / nw,
    }


def metadata_view(docs: DataFrame, source_col: str, lang_col: str, chars_col: str) -> dict[str, Column]:
    """What is known of a page without reading it; a column that isn't there is null."""
    there = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    return {"m_chars": F.log1p(F.greatest(there(chars_col, "double"), F.lit(0.0))), "m_source": there(source_col, "string"), "m_lang": there(lang_col, "string")}


class View(NamedTuple):
    """Binned features of one view: cut points of numbers, known values of names."""

    cuts: dict[str, list[float]]
    names: dict[str, list[str]]

    @classmethod
    def over(cls, sample: pd.DataFrame, numbers: list[str], names: list[str]) -> View:
        quantiles = np.arange(1, BINS) / BINS
        cuts = {c: sorted({float(x) for x in np.nanquantile(sample[c].to_numpy(float), quantiles)}) if sample[c].notna().any() else [] for c in numbers}
        return cls(cuts, {c: sorted(sample[c].dropna().value_counts().head(CATEGORIES).index) for c in names})

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """0/1 columns of a byte each: a constant, `above cut` for every cut, a missing flag, one for each known value."""
        columns = [np.ones(len(rows), np.uint8)]
        for c, cuts in self.cuts.items():
            x = rows[c].to_numpy(float)
            columns += [(x > cut).astype(np.uint8) for cut in cuts] + [np.isnan(x).astype(np.uint8)]
        for c, known in self.names.items():
            columns += [(rows[c] == v).to_numpy(np.uint8) for v in known]
        return np.column_stack(columns)

    def score(self, weights: np.ndarray, columns: dict[str, Column]) -> Column:
        """The same linear score as a column expression."""
        w = iter(float(x) for x in weights)
        total = F.lit(next(w))
        for c, cuts in self.cuts.items():
            for cut in cuts:
                total = total + F.when(columns[c] > F.lit(cut), F.lit(next(w))).otherwise(0.0)
            total = total + F.when(columns[c].isNull() | F.isnan(columns[c]), F.lit(next(w))).otherwise(0.0)
        for c, known in self.names.items():
            for v in known:
                total = total + F.when(columns[c] == F.lit(v), F.lit(next(w))).otherwise(0.0)
        return total


def _pieces(x: np.ndarray, size: int = 4096):
    """(rows, their features as floats) in pieces: a whole matrix is held in bytes alone."""
    for i in range(0, len(x), size):
        yield slice(i, i + size), x[i : i + size].astype(float)


def _linear(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for at, piece in _pieces(x):
        out[at] = piece @ weights
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant and isn't shrunk."""
    weight = np.ones(len(y)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slope, curve = -shrink * w, np.diag(shrink)
        for at, piece in _pieces(x):
            p = _sigmoid(piece @ w)
            slope += piece.T @ (weight[at] * (y[at] - p))
            curve += (piece * (weight[at] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ piece
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _trusted(z: np.ndarray, y: np.ndarray, up: bool) -> bool:
    """Whether the calibration fold bears out this view's confident labels of one class."""
    sure = _sigmoid(z) >= CONFIDENT if up else _sigmoid(z) <= 1 - CONFIDENT
    return bool(sure.sum() >= 5 and (y[sure] == up).mean() >= TRUSTED)


class Model(NamedTuple):
    views: tuple[View, View]
    weights: tuple[np.ndarray, np.ndarray]
    joint: np.ndarray  # constant and a factor for each view's calibrated score
    platt: tuple[np.ndarray, np.ndarray]
    exchanged: tuple[int, int]
    ratios: np.ndarray


def _packed(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["g"]), dtype=np.uint8).reshape(len(rows), GRAMS // 8)


def _with_evidence(rows: pd.DataFrame, values: np.ndarray) -> pd.DataFrame:
    return rows.drop(columns="g").assign(t_grams=values)


def co_train(known: pd.DataFrame, pool: pd.DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Fit on labelled rows (column y) and an unlabelled pool, both with gram bitsets (column g); None if a class is missing."""
    if known["y"].nunique() < 2:
        return None
    draw = np.random.default_rng(SEED)
    fold = draw.permutation(len(known)) % 5 == 0
    if known["y"][fold].nunique() < 2 or known["y"][~fold].nunique() < 2:
        fold = np.zeros(len(known), bool)
    train, hold = known[~fold], known[fold] if fold.any() else known
    held, held_hold, held_pool = _packed(train), _packed(hold), _packed(pool)
    part, part_pool = draw.permutation(len(train)) % FOLDS, draw.permutation(len(pool)) % FOLDS
    text = [c for c in known.columns if c.startswith("t_")] + ["t_grams"]
    meta = View.over(known, list(_NUMBERS), list(_NAMES))
    y, yh = train["y"].to_numpy(float), hold["y"].to_numpy(float)
    own_counts, own_rows = fold_counts(held, y, part)
    given = [np.full(len(pool), np.nan), np.full(len(pool), np.nan)]  # pseudo-labels that each view has been given
    for turn in range(rounds + 1):
        told = ~np.isnan(given[0])
        more, more_rows = fold_counts(held_pool, given[0], part_pool)
        counts, sizes = own_counts + more, own_rows + more_rows
        ratios = log_ratios(counts.sum(axis=0), sizes.sum(axis=0))
        own, own_pool = np.zeros(len(train)), evidence(held_pool, ratios)
        for out in range(FOLDS):
            apart = log_ratios(counts.sum(axis=0) - counts[out], sizes.sum(axis=0) - sizes[out])
            own[part == out] = evidence(held[part == out], apart)
            mine = told & (part_pool == out)
            own_pool[mine] = evidence(held_pool[mine], apart)
        rows = [_with_evidence(train, own), _with_evidence(hold, evidence(held_hold, ratios)), _with_evidence(pool, own_pool)]
        views = (View.over(rows[0], text, []), meta)
        xs, hs, us = ([v.matrix(d) for v in views] for d in rows)
        weights = []
        for x, u, g in zip(xs, us, given, strict=True):
            have = ~np.isnan(g)
            weights.append(fit_logistic(np.vstack([x, u[have]]), np.r_[y, g[have]], np.r_[np.ones(len(y)), np.full(have.sum(), 0.5)]))
        if turn == rounds or not len(pool):
            break
        before = [(~np.isnan(g)).sum() for g in given]
        for me, other in ((0, 1), (1, 0)):
            z = _linear(us[me], weights[me])
            p = _sigmoid(z)
            most = max(1, len(pool) // (2 * rounds))
            for up in (True, False):
                if _trusted(_linear(hs[me], weights[me]), yh, up):
                    sure = np.flatnonzero((p >= CONFIDENT if up else p <= 1 - CONFIDENT) & np.isnan(given[other]))
                    sure = sure[np.argsort(-z[sure] if up else z[sure], kind="stable")]
                    share = (y == up).mean()
                    given[other][sure[: max(1, int(most * share))]] = float(up)
        if [(~np.isnan(g)).sum() for g in given] == before:
            break
    scores = [_linear(h, w) for h, w in zip(hs, weights, strict=True)]
    platt = tuple(fit_logistic(np.column_stack([np.ones(len(yh)), s]), yh) for s in scores)
    calibrated = [a[0] + a[1] * s for a, s in zip(platt, scores, strict=True)]
    joint = fit_logistic(np.column_stack([np.ones(len(yh)), *calibrated]), yh)
    return Model(views, tuple(weights), joint, platt, tuple(int((~np.isnan(g)).sum()) for g in given), ratios)


def _bounded(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of the id: the same rows at any partitioning."""
    return ids.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(most)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all its columns, and text_score, meta_score, score (each 0 to 1) and kept.

    score is the calibrated probability that the label is 1; kept is score >= threshold. The fit reads at most
    ``labelled`` and ``pool`` ids, of an id that repeats in docs the row with the least hash of its text. Of sources and
    languages the CATEGORIES most frequent of that sample are features, all others count alike. Nulls in any column are
    features of their own or count as empty; ids that repeat in docs are scored each, in labels the largest label
    holds. Without labels of both classes nothing can be learnt: scores are null and every document is kept. A
    column named like an output is replaced.
    """
    features = text_view(F.col(text_col)) | metadata_view(docs, source_col, lang_col, chars_col)
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).filter("_id IS NOT NULL")
    taken = _bounded(marked.join(ids.distinct(), "_id", "left_semi"), labelled)
    free = _bounded(ids.join(marked, "_id", "left_anti").distinct(), pool)
    chosen = taken.unionByName(free.withColumn("y", F.lit(None).cast("int")))  # at most labelled + pool rows
    drawn = docs.withColumn("_id", F.col(id_col).cast("long")).join(F.broadcast(chosen), "_id")
    described = [c.alias(n) for n, c in features.items()] + [gram_bits(F.col(text_col)).alias("g")]
    one = F.min(F.struct(F.xxhash64(text_col).alias("h"), *described)).alias("s")  # repeats go before the driver
    sample = drawn.groupBy("_id", "y").agg(one).select("_id", "y", *[f"s.{n}" for n in [*features, "g"]]).toArrow().to_pandas().sort_values("_id")
    known, unknown = sample[sample["y"].notna()], sample[sample["y"].isna()]
    model = co_train(known.assign(y=known["y"].astype(int)).reset_index(drop=True), unknown.reset_index(drop=True), rounds) if len(known) else None
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in ("text_score", "meta_score", "score")} | {"kept": F.lit(True)})
    features["t_grams"] = evidence_of(model.ratios)(F.col(text_col))
    worked = docs.withColumns({f"_f_{n}": c for n, c in features.items()})
    columns = {n: F.col(f"_f_{n}") for n in features}
    logits = [F.lit(float(a[0])) + F.lit(float(a[1])) * v.score(w, columns) for a, v, w in zip(model.platt, model.views, model.weights, strict=True)]
    chance = lambda z: 1 / (1 + F.exp(-z))
    worked = worked.withColumns({"_z0": logits[0], "_z1": logits[1]})
    joint = F.lit(float(model.joint[0])) + F.lit(float(model.joint[1])) * F.col("_z0") + F.lit(float(model.joint[2])) * F.col("_z1")
    worked = worked.withColumns({"text_score": chance(F.col("_z0")), "meta_score": chance(F.col("_z1")), "score": chance(joint)})
    return worked.withColumn("kept", F.col("score") >= threshold).drop(*[f"_f_{n}" for n in features], "_z0", "_z1")
