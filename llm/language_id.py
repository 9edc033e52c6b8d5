"""Language identification by hierarchical discrimination (operator 3).

A text is first given a language family by linear support vector machines, one for each family against
the rest; within the family every two languages have a machine of their own (one-versus-one), and
the language that wins the most of its pairs is taken, of equal ones the one with the greater sum of margins.  Features are hashed character n-grams
(1 to ``LONGEST`` bytes) of the words in lower case, with a mark at either end of a word; a text's
vector is their frequency, damped and scaled to length 1.  The families are Germanic, Romance,
Slavic, and so on for the usual codes; a language of no known family is a family of its own.

Training takes a bounded sample: of each language the ``PER_LANGUAGE`` eligible texts of the smallest
keyed hash, fewer if that were over ``TEXTS`` in all, each with its ``FEATURES`` strongest features; and at most ``LANGUAGES``
languages, the most frequent, so that a rarer one is never predicted (all are parameters).  The texts are counted first, which gives the share of hashes
to look at, so that the candidates are as few at any size.  Vectors are made where the texts are; the driver gets at most
``TEXTS`` * ``FEATURES`` numbers.  The machines are fitted there by averaged stochastic subgradient descent in a
fixed order, so that a rerun gives the same model; its size is fixed by the languages.  Prediction reads the
whole text, a batch at a time, without a shuffle.

Null text, and text without a letter, is ``und`` with score 0; so is everything if there is
nothing to learn from, as in an empty table.  Null languages aren't learned.  Repeated rows are judged each; in the sample equal rows (id and text) may
all be taken.  Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LANGUAGE, LANGUAGES, TEXTS, FEATURES = 400, 200, 20_000, 2048
BITS, LONGEST, EPOCHS, LAMBDA = 15, 4, 8, 1e-5
BLOCK_CHARS = 1 << 19
NOTHING = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32
#: Families of languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl af sv no nb nn da is fo lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc la co sc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu se".split(),
    "baltic": "lt lv".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "semitic": "ar he mt am".split(),
    "indo-iranian": "hi ur bn pa gu mr ne si fa ps ku tg".split(),
    "dravidian": "ta te kn ml".split(),
    "austronesian": "id ms tl jv su mg haw mi".split(),
    "celtic": "ga cy gd br".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def frequencies(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Of each text the damped frequencies of its features, scaled to length 1 (all 0 without features).

    n-grams are of UTF-8 bytes in lower case; what isn't a letter in ASCII is a space, which may
    stand at either end of an n-gram but not within."""
    raw = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = PLAIN[np.frombuffer(b"   ".join([b"", *raw, b"   "]), np.uint8)]
    space = data == 32
    wide = data.astype(np.uint32)
    n = len(data) - LONGEST + 1
    code, bad, features = np.zeros(n, np.uint32), np.zeros(n, bool), []
    for k in range(LONGEST):
        code = code << np.uint32(8) | wide[k : n + k]
        if k > 1:
            bad = bad | space[k - 1 : n + k - 1]  # a space within
        gone = bad | space[:n] & space[k : n + k]
        hashed = ((code + np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)
        features.append(np.where(gone, NOTHING, hashed))
    at = 3
    for r in raw:
        stop = at + len(r)
        first = max(at - 1, 0)
        total = sum(np.bincount(f[first:stop], minlength=NOTHING + 1) for f in features)[:NOTHING]
        value = np.sqrt(total)
        length = np.sqrt(value @ value)
        yield (value / length if length else value).astype(np.float32)
        at = stop + 3


Sparse = tuple[np.ndarray, np.ndarray]


def train(samples: list[Sparse], sign: np.ndarray) -> np.ndarray:
    """A machine for each row of sign (1, -1, or 0 where a sample isn't its business): weights, and the bias in the last column."""
    out = np.zeros((len(sign), (1 << BITS) + 1))
    rng = np.random.default_rng(1)
    own = [np.flatnonzero(sign[:, i]) for i in range(len(samples))]
    n = np.maximum(1, (sign != 0).sum(1))[:, None]
    weight = np.where(sign > 0, n / (2.0 * np.maximum(1, (sign > 0).sum(1)))[:, None], n / (2.0 * np.maximum(1, (sign < 0).sum(1)))[:, None])
    w, total, steps = np.zeros_like(out), np.zeros_like(out), 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            steps += 1
            rate = 0.5 / (1 + 0.5 * steps / len(samples))
            used, value = samples[i]
            rows = own[i]
            cells = np.ix_(rows, used)
            margin = (w[cells] @ value + w[rows, -1]) * sign[rows, i]
            push = np.where(margin < 1, rate * sign[rows, i] * weight[rows, i], 0.0)
            if push.any():
                w[cells] += push[:, None] * value[None, :]
                w[rows, -1] += 0.1 * push
        w *= 1 - LAMBDA * len(samples) * rate
        if epoch >= EPOCHS // 2:
            total += w
    return (total / (EPOCHS - EPOCHS // 2)).astype(np.float32)


def one_against_rest(samples: list[Sparse], classes: list[str], names: list[str]) -> np.ndarray:
    return train(samples, np.array([[1.0 if c == n else -1.0 for c in classes] for n in names]))


def pairs_of(names: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]


def one_versus_one(samples: list[Sparse], classes: list[str], names: list[str]) -> np.ndarray:
    """A machine for every two names, in the order of pairs_of(): positive for the first."""
    return train(samples, np.array([[1.0 if c == names[i] else -1.0 if c == names[j] else 0.0 for c in classes] for i, j in pairs_of(names)]))


def vote(margins: np.ndarray, n: int) -> tuple[int, float]:
    """The winner of the pairs' votes, and how sure its narrowest pair is (0 to 1)."""
    votes, sums, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
    for (i, j), m in zip(pairs_of(list(range(n))), margins.tolist()):
        votes[i if m >= 0 else j] += 1
        for k, own in ((i, m), (j, -m)):
            sums[k] += own
            least[k] = min(least[k], own)
    best = max(range(n), key=lambda k: (votes[k], sums[k], -k))
    return best, float(1 / (1 + np.exp(-6 * least[best])))


class Model:
    """Machines for the families, and for every two languages of a family."""

    def __init__(self, samples: list[tuple[str, Sparse]]):
        known = [(lang, v) for lang, v in samples if len(v[0])]
        self.families = sorted({family(lang) for lang, _ in known})
        self.languages = {f: sorted({lang for lang, _ in known if family(lang) == f}) for f in self.families}
        self.top = one_against_rest([v for _, v in known], [family(lang) for lang, _ in known], self.families) if len(self.families) > 1 else None
        self.inner = {}
        for f, names in self.languages.items():
            if len(names) > 1:
                own = [(lang, v) for lang, v in known if family(lang) == f]
                self.inner[f] = one_versus_one([v for _, v in own], [lang for lang, _ in own], names)

    def predict(self, value: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return "und", 0.0
        i, sure = 0, 1.0
        if self.top is not None:
            margin = (self.top[:, :-1] @ value + self.top[:, -1]).astype(float)
            i = int(margin.argmax())
            sure = float(1 / (1 + np.exp(-3 * (margin[i] - np.delete(margin, i).max()))))
        names = self.languages[self.families[i]]
        if (w := self.inner.get(self.families[i])) is None:
            return names[0], sure
        k, surer = vote((w[:, :-1] @ value + w[:, -1]).astype(float), len(names))
        return names[k], sure * surer


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, eligible: Column, per_language: int, languages: int, texts: int = TEXTS, features: int = FEATURES) -> list[tuple[str, Sparse]]:
    """Bounded sample of labelled texts as vectors, chosen by the hash of id and text."""
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(7)).alias("h"), F.col(text_col).alias("text"))
    most = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not most:
        return []
    wanted = max(1, min(per_language, texts // len(most)))
    below = F.lit(False)
    for name, n in most.items():  # hashes are spread evenly: this share of them has a quarter more than are wanted, and some
        share = (1.25 * wanted + 50) / n
        below = below | ((F.col("lang") == name) & (F.col("h") <= (2**63 - 1 if share >= 1 else int(share * 2.0**64) - 2**63)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = next(frequencies([batch.column(2)[i].as_py()]))
                used = np.flatnonzero(value)
                if len(used) > features:
                    used = np.sort(used[np.argsort(-value[used], kind="stable")[:features]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([used.astype(np.int32).tobytes()]), pa.array([value[used].tobytes()])], ["lang", "h", "used", "value"])

    few = rows.where(below).mapInArrow(vectors, "lang string, h long, used binary, value binary")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "used"))).where(F.col("rank") <= wanted)
    found = sorted((r["lang"], r["h"], bytes(r["used"]), bytes(r["value"])) for r in few.collect())  # texts * features numbers at most
    return [(lang, (np.frombuffer(u, np.int32), np.frombuffer(v, np.float32).astype(float))) for lang, _, u, v in found]


def identify(docs: DataFrame, eligible: Column, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred, score (0 to 1) of every row, by machines trained on rows where ``eligible`` holds."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(sample(docs, id_col, text_col, lang_col, eligible, per_language, languages)))  # of fixed size for each language
    id_sql = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, some, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                some.append(text.as_py())
                size += len(some[-1] or "")
                if size >= BLOCK_CHARS or i + 1 == batch.num_rows:
                    found += [model.value.predict(v) if has_letter(t) else ("und", 0.0) for t, v in zip(some, frequencies(some))]
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_sql}, lang_pred string, score double").withColumnRenamed("id", id_col)
