"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs inside the family.

Features are hashed n-grams of 2, 3 and 4 bytes of the text with letters lowered and runs of anything else as one space; a
text's value for a model is its mean weight over all its n-grams. Models are trained with a squared hinge loss on the driver
from sparse counts of at most ``per_language`` different labelled texts of each language, those with the least hashes. How many
languages and models there are is bounded, so junk labels cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citygeo.llm.common import checkpoint, documents, pieces, raw_text, tidy

BITS = 15
SIZES = (2, 3, 4)
STEP = 1 << 20
PART = 1 << 18  # counts that training looks at together
PER_LANGUAGE = 600
MOST_LANGUAGES, MOST_MODELS = 200, 400
NONE = "und"
# Families of closely related languages, by code. A language that is missing here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "pl cs sk ru uk be bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn ur mr ne gu pa",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_SIMPLE = np.full(256, 0x20, np.uint8)
_SIMPLE[0x80:] = np.arange(0x80, 0x100)
_SIMPLE[ord("a") : ord("z") + 1] = _SIMPLE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER = regex.compile(r"\p{L}")


def simple_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered letters, one space for runs of other ASCII, and where each text begins now."""
    data = _SIMPLE[data]
    if len(data) > 1:  # capitals of Latin-1
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][second] += 0x20
    blank = data == 0x20
    drop = np.zeros(len(data), bool)
    drop[1:] = blank[1:] & blank[:-1]
    drop[offsets[(offsets > 0) & (offsets < len(data))]] = False
    kept = np.r_[0, np.cumsum(~drop)]
    return data[~drop], kept[offsets]


def gram_slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams, a slice at a time. No n-gram crosses from one text to the next."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    for at in range(0, len(data), STEP):
        own = owner[at : at + STEP]
        part = data[at : at + STEP + max(SIZES) - 1].astype(np.uint32)
        rest = owner[at : at + STEP + max(SIZES) - 1]
        code = part.copy()
        for n in range(2, max(SIZES) + 1):
            code = code[:-1] * np.uint32(0x01000193) ^ part[n - 1 :]
            if n in SIZES:
                m = min(len(own), len(code))
                inside = own[:m] == rest[n - 1 : n - 1 + m]
                bucket = ((code[:m] * np.uint32(n * 2 + 1)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                yield own[:m][inside], bucket[inside]


@dataclass
class Hierarchy:
    languages: list[str]
    families: list[str]
    weights: np.ndarray  # bucket x model: a model for each family, then one for each pair of a family
    bias: np.ndarray
    pairs: list[tuple[int, int]]  # languages: a positive margin is for the first

    def margins(self, column: pa.Array) -> np.ndarray:
        data, offsets = simple_bytes(*raw_text(column))
        n, models = len(offsets) - 1, len(self.bias)
        total, count = np.zeros((n, models)), np.zeros(n)
        for owner, bucket in gram_slices(data, offsets):
            count += np.bincount(owner, minlength=n)
            for m in range(models):
                total[:, m] += np.bincount(owner, self.weights[m][bucket], minlength=n)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = column.to_pylist()
        if not self.languages:
            return [NONE] * len(texts), np.zeros(len(texts))
        margin = self.margins(column)
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
        of_family = margin[:, : len(self.families)]
        family = of_family.argmax(axis=1)
        share = sure[np.arange(len(texts)), family] if len(self.families) > 1 else np.ones(len(texts))
        votes = np.zeros((len(texts), len(self.languages)))
        strength = np.zeros_like(votes)
        for k, (a, b) in enumerate(self.pairs, len(self.families)):
            votes[:, a] += sure[:, k] > 0.5
            votes[:, b] += sure[:, k] <= 0.5
            strength[:, a] += sure[:, k]
            strength[:, b] += 1 - sure[:, k]
        for i, language in enumerate(self.languages):
            votes[family != self.families.index(family_of(language)), i] = -1
        best = (votes + strength / (len(self.languages) + 1)).argmax(axis=1)
        rivals = np.array([sum(i in pair for pair in self.pairs) for i in range(len(self.languages))])
        score = share * np.where(rivals[best] > 0, strength[np.arange(len(texts)), best] / np.maximum(rivals[best], 1), 1.0)
        lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        return [self.languages[b] if ok else NONE for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, np.clip(score, 0, 1), 0.0)


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.split("-")[0].lower(), language)


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        data, offsets = simple_bytes(*raw_text(piece.column(1)))
        n = len(offsets) - 1
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for owner, bucket in gram_slices(data, offsets):
            new, times = np.unique(owner.astype(np.int64) << BITS | bucket, return_counts=True)
            keys, counts = np.concatenate([keys, new]), np.concatenate([counts, times])
        keys, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, counts, len(keys)) if len(keys) else counts
        edge = np.searchsorted(keys >> BITS, np.arange(n + 1))
        rows = [(keys[a:b] & ((1 << BITS) - 1)).tolist() for a, b in zip(edge[:-1], edge[1:])]
        shares = [(counts[a:b] / max(1, counts[a:b].sum())).tolist() for a, b in zip(edge[:-1], edge[1:])]
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "bucket", "share"])


def _train(bucket: np.ndarray, share: np.ndarray, size: np.ndarray, sign: np.ndarray, rounds: int = 150, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, balanced classes) by accelerated gradient steps. Rows are sparse: size
    tells how many of the buckets and shares are each row's."""
    importance = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    ends = np.cumsum(size)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PART, ends[-1], PART), "right"), len(size)])
    # a part of the rows at a time, so that what stands beside the counts themselves is small
    parts = [(a, b, slice(ends[a] - size[a], ends[b - 1]), np.repeat(np.arange(b - a, dtype=np.int32), size[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    w = v = np.zeros(1 << BITS)
    bias = u = 0.0
    largest = max(float(np.bincount(owner, share[at] ** 2).max(initial=1e-9)) for _, _, at, owner in parts)
    step = 1 / (2 * (largest + 1e-3) + ridge)
    before = np.inf
    for k in range(rounds):
        slack, pull, slope = np.zeros(len(size)), np.zeros(len(size)), ridge * v
        for a, b, at, owner in parts:
            here = bucket[at]
            margin = np.bincount(owner, share[at] * v[here], b - a) + u
            slack[a:b] = np.maximum(0, 1 - sign[a:b] * margin)
            pull[a:b] = -2 * importance[a:b] * slack[a:b] * sign[a:b]
            slope += np.bincount(here, pull[a:b][owner] * share[at], 1 << BITS)
        new_w = v - step * slope
        new_b = u - 0.2 * pull.sum()
        v, u = new_w + k / (k + 3) * (new_w - w), new_b + k / (k + 3) * (new_b - bias)
        w, bias = new_w, new_b
        if k % 10 == 9:
            loss = float((importance * slack**2).sum())
            if k >= 49 and loss > 0.995 * before:
                break
            before = loss
    return w, bias


def learnable(often: list[str], most_models: int = MOST_MODELS) -> list[str]:
    """Of languages in this order, those whose models (one for each family, one for each pair of a family) are most_models at most in
    all; one that would exceed this is passed over."""
    own: dict[str, int] = {}
    models, out = 0, []
    for language in often:
        family = family_of(language)
        more = own.get(family, 0) if family in own else 1
        if models + more <= most_models:
            models, own[family] = models + more, own.get(family, 0) + 1
            out.append(language)
    return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, most_models: int = MOST_MODELS) -> Hierarchy:
    """A model of the non-null languages of labelled. Repeated texts count once; of a language's different texts the per_language
    with the least hashes are learned from, all of them where there are fewer, so each language has one at least.

    Languages are learned in order of their numbers of different texts (ties: by name), most_languages at most, as long as their models
    are most_models at most (128 KB each); rarer labels beyond that are not learned and never predicted. So the driver gets
    most_languages * per_language sparse rows at most, and what goes to tasks does not grow with the number of labels."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    kinds = checkpoint(rows.select("lang", "key").distinct())
    often = kinds.groupBy("lang").agg(F.count("*").alias("texts")).orderBy(F.desc("texts"), "lang").limit(most_languages).collect()
    texts = {r.lang: r.texts for r in often}
    # a first cut by hash leaves twice the texts wanted, on average, to be ranked
    share = F.broadcast(spark.createDataFrame([(x, 2.0 * per_language / texts[x]) for x in learnable([*texts], most_models)], "lang string, share double"))
    near = kinds.join(share, "lang").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")))
    picked = F.broadcast(ranked.filter(F.col("rank") <= per_language).select("lang", "key"))  # most_languages * per_language rows at most
    chosen = rows.join(picked, ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "text")
    found = chosen.mapInArrow(_sparse_rows, "lang string, bucket array<int>, share array<float>").toArrow()
    lang = found.column("lang").to_pylist()
    lists = found.column("bucket").combine_chunks()
    size, bucket = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
    share = found.column("share").combine_chunks().flatten().to_numpy()
    del found, lists
    languages = sorted(set(lang))
    families = sorted({family_of(x) for x in languages})
    models = []
    for family in families:
        sign = np.array([1.0 if family_of(x) == family else -1.0 for x in lang])
        models.append(_train(bucket, share, size, sign) if len(families) > 1 else (np.zeros(1 << BITS), 1.0))
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of(languages[a]) == family_of(languages[b])]
    for a, b in pairs:
        own = np.array([x in (languages[a], languages[b]) for x in lang])
        sign = np.array([1.0 if x == languages[a] else -1.0 for x in lang])[own]
        part = np.repeat(own, size)
        models.append(_train(bucket[part], share[part], size[own], sign))
    del bucket, share
    tidy()
    return Hierarchy(languages, families, np.array([w for w, _ in models], np.float32), np.array([b for _, b in models]), pairs)


def identify(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row of docs: id, lang_pred, score (0 to 1); with carry all columns of docs, and these two (replacing any so called).

    Null, empty and letterless texts get ``und`` with score 0, and so do all texts if the model learned no language. Ids may be
    null or repeat. Whole texts count, however long. Without carry other columns of docs are not read.
    """
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")] if carry else [id_col]
    rows = docs.select(rest[0], text_col, *rest[1:]) if carry else docs.select(id_col, F.col(text_col).alias("_text"))
    kept = rows.columns if carry else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            names, score = model.predict(piece.column(1))
            yield pa.RecordBatch.from_arrays([*(piece.columns if carry else piece.columns[:1]), pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = StructType([*(rows.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
