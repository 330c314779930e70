"""Quality classifier by co-training.

Two views of a document that share no input: its content (hashed byte trigrams and layout figures of the whole text) and
its page metadata (language, source and the stated length).  A logistic classifier of each view starts from the labelled
rows.  In each round both score all unlabelled documents, on Spark; the rows that one is most sure of, the same share of the
corpus for both, in the proportion of the classes, get its label and join the training rows of the other.  Each view
is then calibrated (Platt scaling) and the two calibrated log-odds are combined by a last logistic fit, on labelled rows
held out for that; the threshold is set on others held out; every document is scored.

Bounded parts, by parameter: at most ``labelled`` labelled rows, and of each round's confident rows at most ``taken`` a view,
chosen by a hash of doc_id among all of them, come to the driver as feature vectors of fixed width; the model is a few
thousand numbers.  Which rows are confident is judged over the whole corpus.

The threshold is at most one half, and low enough that ``keep_good`` of the held-out good rows stay.

Defined cases: a null text is empty; null lang, source or n_chars are values of their own; labels that are null or whose
doc_id is null are left out, and repeated labels of a document count by majority; documents with a null doc_id are
scored and not trained on; where a held-out part would lack a class, all labelled rows serve all parts; without two
classes of labels every score is one half and every document is kept; an empty table gives no rows; other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from lodestone.llm.common import Scratch

LABELLED = 6_000
TAKEN = 2_000
ROUNDS = 3
#: Share of the corpus that a view is sure of in a round, and the least log-odds either way.
SHARE, SURE = 0.04, 1.0
GRAMS, LAYOUT = 1024, 8
SOURCES, LANGS = 64, 16
TEXT, META = GRAMS + LAYOUT, SOURCES + LANGS + 2
VIEWS = ("text", "meta")
SCORES = StructType([StructField(x, DoubleType()) for x in ("text_score", "meta_score", "score")] + [StructField("keep", BooleanType())])


def content_features(text: str) -> np.ndarray:
    """Log-scaled, unit-length counts of hashed byte trigrams, and layout figures."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.concatenate([b, np.zeros(3 - len(b), np.uint32)])
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = (gram * np.uint32(2654435761)) >> np.uint32(22)
    x = np.log1p(np.bincount(slot, minlength=GRAMS).astype(np.float32))
    lines = text.split("\n")
    size = [len(line) for line in lines]
    spaces = text.count(" ") + len(lines)
    layout = (
        np.log1p(len(text)) / 5, np.log1p(len(lines)) / 3, np.log1p(max(size)) / 5, np.log1p(len(text) / len(lines)) / 5,
        len(set(lines)) / len(lines), min(len(text) / spaces, 40) / 10, sum(s < 20 for s in size) / len(lines), 1.0 if not text else 0.0,
    )
    return np.append(x / max(float(np.sqrt(x @ x)), 1e-9), np.asarray(layout, np.float32))


def metadata_features(lang: str | None, source: str | None, n_chars) -> np.ndarray:
    x = np.zeros(META, np.float32)
    x[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    x[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    missing = n_chars is None or n_chars != n_chars
    x[-2:] = (0.0, 1.0) if missing else (np.log1p(max(float(n_chars), 0.0)) / 5, 0.0)
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights, the intercept last: accelerated gradient steps on the penalised log-loss."""
    weight = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
    weight = weight / weight.sum()
    y = y.astype(np.float32)
    bound = 0.25 * float((weight * ((x * x).sum(1) + 1)).sum()) + penalty
    rate = np.float32(1.0 / bound)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v = w.copy()
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30)))
        e = weight * (p - y)
        grad = np.append(x.T @ e + penalty * v[:-1], e.sum()).astype(np.float32)
        last, w = w, v - rate * grad
        v = w + np.float32(k / (k + 3)) * (w - last)
    return w


def log_odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x @ w[:-1] + w[-1]).astype(np.float64)


def balanced(y: np.ndarray) -> np.ndarray:
    good = max(float(y.mean()), 1e-6)
    return np.where(y > 0, 0.5 / good, 0.5 / max(1 - good, 1e-6))


def fit_line(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic fit on few columns, by Newton's method with a small penalty."""
    a = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), a.T @ (p - y) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(rows: dict[str, list[np.ndarray]], given: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    """Weights of both views, each from its own training rows."""
    out = {}
    for v in VIEWS:
        y = np.concatenate(given[v])
        out[v] = fit_logistic(np.concatenate(rows[v]), y, balanced(y))
    return out


def calibrated(weights: dict[str, np.ndarray], views: dict[str, np.ndarray], label: np.ndarray, held: np.ndarray, last: np.ndarray, keep_good: float) -> dict:
    """The model: calibration and combination from the rows ``held``, the threshold from the rows ``last``."""
    model: dict = dict(weights)
    y = label[held].astype(np.float64)
    for v in VIEWS:
        model[f"{v}_line"] = fit_line(log_odds(weights[v], views[v][held])[:, None], y)
    model["both"] = fit_line(combined(model, {v: log_odds(weights[v], views[v][held]) for v in VIEWS}), y)
    odds = combined(model, {v: log_odds(weights[v], views[v][last]) for v in VIEWS})
    score = 1 / (1 + np.exp(-np.clip(odds @ model["both"][:2] + model["both"][2], -30, 30)))
    model["threshold"] = float(min(0.5, np.quantile(score[label[last] > 0], 1 - keep_good)))
    return model


def combined(model: dict, z: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([z[v] * model[f"{v}_line"][0] + model[f"{v}_line"][1] for v in VIEWS])


def columns_of(docs: DataFrame) -> DataFrame:
    """id, text, lang, source, n_chars of ``docs`` and, in ``carried``, all its columns; a column that is missing counts as null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    named = {"doc_id": "id"}
    return docs.select(*((docs[c] if c in docs.columns else F.lit(None)).cast(k).alias(named.get(c, c)) for c, k in kinds.items()), F.struct(*(docs[c] for c in docs.columns)).alias("carried"))


def vectors(rows: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """id, label, a mixed order, and the features of both views, of the rows in ``ids`` (id, label), which are few by a bound."""
    kind = StructType([StructField("t", BinaryType()), StructField("m", BinaryType())])

    @F.pandas_udf(kind)
    def features(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"t": [content_features(t or "").astype(np.float16).tobytes() for t in text], "m": [metadata_features(*r).tobytes() for r in zip(lang, source, n_chars)]}, columns=["t", "m"])

    found = rows.drop("carried").join(F.broadcast(ids), "id").select("id", "label", F.xxhash64("text").alias("h"), features("text", "lang", "source", "n_chars").alias("f"))
    # of rows that repeat an id the one with the smallest hash of its text, chosen before anything comes to the driver
    found = found.groupBy("id", "label").agg(F.min(F.struct("h", "f.t", "f.m")).alias("f"))
    got = found.select("id", "label", "f.t", "f.m").toPandas().sort_values("id", kind="stable")
    # mixed by a hash, so that which rows are held out does not follow doc_id
    got = got.iloc[np.argsort([zlib.crc32(b"%d" % i) for i in got["id"]], kind="stable")]
    text = np.frombuffer(b"".join(got["t"]), np.float16).reshape(len(got), TEXT).astype(np.float32)
    meta = np.frombuffer(b"".join(got["m"]), np.float32).reshape(len(got), META)
    return got["id"].to_numpy(), got["label"].to_numpy(), np.arange(len(got)), {"text": text, "meta": meta}


def view_scores(rows: DataFrame, weights: dict[str, np.ndarray]):
    """id and the log-odds of both views for all ``rows``."""
    kind = StructType([StructField(v, DoubleType()) for v in VIEWS])

    @F.pandas_udf(kind)
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(both_views(weights, text, lang, source, n_chars), columns=list(VIEWS))

    return rows.select("id", run("text", "lang", "source", "n_chars").alias("z")).select("id", "z.*")


def both_views(weights: dict[str, np.ndarray], text, lang, source, n_chars) -> dict[str, np.ndarray]:
    z = {v: np.zeros(len(text)) for v in VIEWS}
    for k, (t, *m) in enumerate(zip(text, lang, source, n_chars)):
        z["text"][k] = content_features(t or "") @ weights["text"][:-1] + weights["text"][-1]
        z["meta"][k] = metadata_features(*m) @ weights["meta"][:-1] + weights["meta"][-1]
    return z


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taken: int = TAKEN, rounds: int = ROUNDS, share: float = SHARE, keep_good: float = 0.995) -> dict | None:
    """The model, or None without two classes of labels; labels: doc_id, quality."""
    votes = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("q"))
    chosen = votes.select("id", F.when(F.col("q") >= 0.5, 1).otherwise(0).alias("label")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    rows, scratch = columns_of(docs), Scratch()
    _, label, place, views = vectors(rows, chosen)
    if len(set(label)) < 2:
        return None
    held, last = (np.flatnonzero(place % 8 == k) for k in (0, 4))
    train = np.flatnonzero(place % 4 != 0)
    if any(len(set(label[part])) < 2 for part in (train, held, last)):
        train = held = last = place
    good = float(label[train].mean())
    own = {v: [views[v][train]] for v in VIEWS}
    given = {v: [label[train].astype(np.float32)] for v in VIEWS}
    open_ = rows.where("id IS NOT NULL").join(F.broadcast(chosen.select("id")), "id", "left_anti").drop("carried")
    used = chosen.select("id").limit(0)
    for _ in range(rounds):
        weights = trained(own, given)
        scored = scratch.keep(view_scores(open_, weights).join(F.broadcast(used), "id", "left_anti"), "views")
        bounds = scored.agg(*(F.percentile_approx(v, [share * (1 - good), 1 - share * good], 10_000).alias(v) for v in VIEWS)).first()
        picks = []
        for v in VIEWS:
            if bounds[v] is None:
                continue
            low, high = min(bounds[v][0], -SURE), max(bounds[v][1], SURE)
            for sure, mark, most in ((F.col(v) <= low, 0, taken * (1 - good)), (F.col(v) >= high, 1, taken * good)):
                picks.append(scored.where(sure).select("id", F.lit(mark).alias("label"), F.lit(v).alias("view")).orderBy(F.xxhash64("id"), "id").limit(max(1, round(most))))
        if not picks:
            break
        sure = picks[0]
        for p in picks[1:]:
            sure = sure.union(p)
        sure = sure.toPandas()  # at most 2 * taken rows of three values
        if not len(sure):
            break
        few = docs.sparkSession.createDataFrame([(int(i), -1) for i in sorted(set(sure["id"]))], StructType([StructField("id", LongType()), StructField("label", LongType())]))
        ids, _, _, found = vectors(rows, few)
        at = {i: k for k, i in enumerate(ids)}
        for v, other in (VIEWS, VIEWS[::-1]):
            mine = sure[sure["view"] == v]
            own[other].append(found[other][[at[i] for i in mine["id"]]])
            given[other].append(mine["label"].to_numpy(np.float32))
        used = used.union(few.select("id"))
    model = calibrated(trained(own, given), views, label, held, last, keep_good)
    scratch.drop()
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """carried (a struct of all columns of ``docs``), quality (text_score, meta_score, score, keep) of every row."""

    @F.pandas_udf(SCORES)
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        n = len(text)
        if model is None:
            return pd.DataFrame({"text_score": [0.5] * n, "meta_score": [0.5] * n, "score": [0.5] * n, "keep": [True] * n})
        odds = combined(model, both_views(model, text, lang, source, n_chars))
        final = odds @ model["both"][:2] + model["both"][2]
        p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (odds[:, 0], odds[:, 1], final)]
        return pd.DataFrame({"text_score": p[0], "meta_score": p[1], "score": p[2], "keep": p[2] >= model["threshold"]})

    return columns_of(docs).select("carried", run("text", "lang", "source", "n_chars").alias("quality"))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taken: int = TAKEN) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep of every document."""
    scored = score(docs, fit(docs, labels, labelled, taken))
    return scored.select(F.col("carried.doc_id").cast("long").alias("doc_id"), *(F.col(f"quality.{c}").alias(c) for c in SCORES.names))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return score(docs, fit(docs, labels)).where("quality.keep").select("carried.*")
