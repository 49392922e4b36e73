"""Language identification by hierarchical discrimination (operator 13).

A text is first given to a language family, then to a language of that family. Every decision is a
one-versus-one linear support vector machine: between two families at the first level, between two
related languages at the second; the class with most wins is taken. Features are hashed letter
n-grams of whole words with their ends, one to four bytes of lower-cased UTF-8, by log counts of unit
length. Families come from a table of language codes; a code that it lacks is a family of its own.

Each machine is trained in a task of its own by dual coordinate descent, on a bounded sample: about
`sample` labelled documents of each class (those whose id hashes below sample / count, so the sample
is the same on every run). Labelled documents are all those that the caller marks for training;
predictions use the text alone. Weights grow with the square of the languages of a family, and of
families, never with documents.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if
nothing was learnt; one learnt language is predicted for all others. Ties of wins go to the larger
sum of margins, then to the first class by name. Documents of equal id and language count once in
training, by their least text; null ids hash as empty strings; null languages teach nothing; an
empty table gives no rows; very long texts are read whole, in blocks; extra columns, whatever their
names, are ignored or, if asked for, carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import column, map_rows, materialize

# ISO 639 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af yi lb fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "hellenic": "el",
    "albanian": "sq",
    "armenian": "hy",
    "iranian": "fa ps ku tg",
    "indo-aryan": "hi ur bn mr ne gu pa or as si sa",
    "dravidian": "ta te kn ml",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt ug",
    "mongolic": "mn",
    "semitic": "ar he am mt ti",
    "cushitic": "so om",
    "bantu": "sw zu xh sn rw ln ny st tn",
    "sinitic": "zh yue",
    "japonic": "ja",
    "koreanic": "ko",
    "tai": "th lo",
    "austroasiatic": "vi km",
    "austronesian": "id ms tl jv su mg mi haw",
    "basque": "eu",
    "kartvelian": "ka",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
#: Bytes that a word may hold; all others part words. Bytes beyond ASCII are taken for letters.
_WORD_BYTE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text whose n-grams are hashed at a time.
BLOCK = 1 << 20
#: Texts whose features are held at a time.
TEXTS = 128


@dataclass(frozen=True)
class LanguageParams:
    dims: int = 1 << 14
    sample: int = 1000
    epochs: int = 12
    cost: float = 1.0
    sharpness: float = 3.0


def family_of(lang: str) -> str:
    """The family of a language code, or the code itself."""
    return _FAMILY_OF.get(regex.split(r"[-_]", lang.lower())[0], lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(texts: list[str], dims: int) -> np.ndarray:
    """Log counts of hashed n-grams, one row of unit length for each text."""
    raw = b" " + b"".join(t.lower().encode("utf-8", "replace").translate(_WORD_BYTE) + b" " for t in texts)
    ends = np.cumsum([0] + [len(t.lower().encode("utf-8", "replace")) + 1 for t in texts])
    counts = np.zeros(len(texts) * dims, np.int64)
    view = np.frombuffer(raw, np.uint8)
    for begin in range(0, len(view), BLOCK):
        some = view[begin : begin + BLOCK + 3]  # n-grams that begin in the block
        code, valid = np.zeros(len(some), np.uint32), None
        for n in range(1, 5):
            here = len(some) - n + 1
            if here < 1:
                break
            code = code[:here] * np.uint32(257) + some[n - 1 :] + np.uint32(1)
            # inner bytes are letters; single bytes are, and pairs are not both white space
            if n == 1:
                valid = some != 32
                letters = valid
            elif n == 2:
                valid = letters[:here] | letters[1:]
            else:
                inner = letters[1 : here + 1] if n == 3 else inner[:here] & letters[2 : here + 2]
                valid = inner
            at = np.flatnonzero(valid[: min(here, BLOCK)])
            hashed = (code[at] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(12)
            # a gram belongs to the text of its second byte: the space before a text is that of the text before
            owner = np.searchsorted(ends[1:], begin + at + (1 if n > 1 else 0) - 1, side="right")
            counts += np.bincount(owner * dims + hashed % np.uint32(dims), minlength=len(counts))
    rows = np.log1p(counts.reshape(len(texts), dims), dtype=np.float32)
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), np.float32(1e-9))


def train_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, params: LanguageParams) -> np.ndarray:
    """Weights, the bias last, of a linear machine with squared hinge loss, by dual coordinate descent; classes weigh alike."""
    w, alpha = np.zeros(dims + 1), np.zeros(len(y))
    cost = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) * params.cost
    rng = np.random.default_rng(7)
    for _ in range(params.epochs):
        for i in rng.permutation(len(y)):
            at, value = x[i]
            gradient = y[i] * (w[at] @ value + w[dims]) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - gradient / (2.0 + 1 / (2 * cost[i])), 0.0)  # rows have unit length, and the bias is one more
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * value
                w[dims] += step
                alpha[i] = new
    return w.astype(np.float32)


class LanguageModel:
    """Families, their languages, and the weights of every pair."""

    def __init__(self, langs: list[str], weights: dict[tuple[str, str, str], np.ndarray], params: LanguageParams):
        self.params = params
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.pairs = sorted(weights)
        self.weights = np.stack([weights[p] for p in self.pairs], axis=1) if weights else np.zeros((params.dims + 1, 0), np.float32)

    def _winner(self, level: str, names: list[str], margins: dict) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        wins, total, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            m = margins[level, a, b]
            chance = 1 / (1 + np.exp(-self.params.sharpness * m))
            wins[a if m > 0 else b] += 1
            for c, s, p in ((a, m, chance), (b, -m, 1 - chance)):
                total[c] += s
                sure[c] += p
        best = min(names, key=lambda c: (-wins[c], -total[c], c))
        return best, sure[best] / (len(names) - 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.families and has_letter(t)]
        for at in range(0, len(known), TEXTS):
            some = known[at : at + TEXTS]
            x = features([texts[i] for i in some], self.params.dims)
            margins = x @ self.weights[:-1] + self.weights[-1]
            for i, row in zip(some, margins.astype(float).tolist()):
                by_pair = dict(zip(self.pairs, row))
                family, sure = self._winner("family", sorted(self.families), by_pair)
                lang, surer = self._winner("language", self.families[family], by_pair)
                out[i] = lang, float(sure * surer)
        return out


def train(docs: DataFrame, text: str, lang: str, doc_id: str, use: Column, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """The model learnt from rows that `use` selects; see the module for the sample's bound."""
    named = docs.select(column(doc_id).cast("string").alias("i"), column(lang).cast("string").alias("l"), column(text).alias("t"), use.alias("u"))
    taught = named.where("u AND l IS NOT NULL")
    langs = {r.l: r.n for r in taught.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    in_family: dict[str, int] = {}
    for code, n in langs.items():
        in_family[family_of(code)] = in_family.get(family_of(code), 0) + n
    families = sorted(in_family)
    groups = [("family", families)] + [("language", sorted(x for x in langs if family_of(x) == f)) for f in families]
    problems = [(level, a, b) for level, names in groups for a, b in combinations(names, 2)]
    if not problems:
        return LanguageModel(list(langs), {}, params)
    # what each language teaches: a problem, its side, and the share of its documents that serve
    roles = []
    for x, n in langs.items():
        mine = {"family": (family_of(x), in_family[family_of(x)]), "language": (x, n)}
        for k, (level, a, b) in enumerate(problems):
            name, total = mine[level]
            if name in (a, b):
                roles.append((x, k, 1 if name == a else -1, params.sample / total))
    spark = docs.sparkSession
    most = {x: max(r[3] for r in roles if r[0] == x) for x in {r[0] for r in roles}}
    hashed = taught.withColumn("h", F.xxhash64(F.coalesce("i", F.lit(""))) / F.lit(float(1 << 64)) + 0.5)
    limits = spark.createDataFrame([(x, float(s)) for x, s in most.items()], "l string, most double")
    chosen = hashed.join(F.broadcast(limits), "l").where("h < most").groupBy("l", "h").agg(F.min("t").alias("t"))
    dims = params.dims

    def make():
        def step(batch: pa.RecordBatch):
            texts, keep = batch.column(2).to_pylist(), []
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(keep), TEXTS):
                some = keep[at : at + TEXTS]
                x = features([texts[i] for i in some], dims)
                used = [np.flatnonzero(row).astype(np.int32) for row in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(used, pa.list_(pa.int32())), pa.array([row[u] for row, u in zip(x, used)], pa.list_(pa.float32()))],
                    names=["l", "h", "at", "value"],
                )

        return step

    sample, _ = materialize(map_rows(chosen.select("l", "h", "t"), "l string, h double, at array<int>, value array<float>", make), "language-sample")
    taught_by = spark.createDataFrame(roles, "l string, problem int, y int, share double")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["l", "h"])
        x = [(np.asarray(a), np.asarray(v, dtype=float)) for a, v in zip(rows["at"], rows["value"])]
        w = train_svm(x, rows["y"].to_numpy(), dims, params)
        return pd.DataFrame({"problem": [rows["problem"].iloc[0]], "w": [w.tobytes()]})

    fitted = sample.join(F.broadcast(taught_by), "l").where("h < share").groupBy("problem").applyInPandas(fit, "problem int, w binary")
    weights = dict.fromkeys(problems, np.zeros(dims + 1, np.float32))  # where no text of either class has a letter
    weights |= {problems[r.problem]: np.frombuffer(r.w, np.float32) for r in fitted.collect()}  # a row a pair of classes
    return LanguageModel(list(langs), weights, params)


def identify(docs: DataFrame, text: str, carry: list[str], model: LanguageModel) -> DataFrame:
    """carry columns as c0, c1, ..., `lang_pred` and `score` of every row."""
    named = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(carry)], column(text).alias("t"))
    schema = T.StructType([named.schema[f"c{i}"] for i in range(len(carry))] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        def step(batch: pa.RecordBatch):
            found = model.predict(batch.column(len(carry)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names
            )

        return step

    return map_rows(named, schema, make)


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 4 == 2
    model = train(docs, "text", "lang", "doc_id", ~out(F.col("doc_id")))
    return identify(docs, "text", ["doc_id"], model).select(F.col("c0").alias("doc_id"), out(F.col("c0")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}
