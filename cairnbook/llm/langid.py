"""Language identification: averaged hashed subword embeddings and a linear softmax, with rejection.

A text is the mean of the embeddings of all its byte n-grams (hashed into ``buckets`` rows) and its language
the softmax of a linear map of that mean.  Both are trained by stochastic gradient descent in numpy on the
driver, from a sample of at most ``per_language`` labelled rows of each language.  A fifth of the sample is
kept from training to calibrate: a temperature, fitted on whole texts and short pieces, makes the scores
probabilities, and a text is
rejected when its score, or the share of its n-grams that training met, is below what all but
``reject_share`` of these texts reach.  Prediction reads whole texts in one pass; as the map is
linear, embeddings and map are multiplied once and a text costs one table row per n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.llm.common import BATCH_ROWS, blocks, forget, table, whole_texts

PER_LANGUAGE = 600
BUCKETS = 1 << 18
DIMENSIONS = 16
EPOCHS = 6
REJECT_SHARE = 0.002
UNKNOWN = "und"
_GRAMS = (3, 4)
_PART = 1 << 20
# Lower case for A-Z; every ASCII character that is not a letter is a blank.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                  ("score", pa.float64()), ("rejected", pa.bool_())])


@dataclass
class Model:
    """``weights``: one row per bucket, the score of each of ``names`` and whether training met the bucket."""

    names: list[str]
    weights: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = 0.0


def buckets_of(flat: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte of ``flat`` but the last n - 1."""
    many = max(0, len(flat) - n + 1)
    code = flat[:many].astype(np.uint32)
    for k in range(1, n):
        code |= flat[k:k + many].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77 + 2 * n)
    return code >> np.uint32(32 - int(buckets).bit_length() + 1)


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8)


def _bag(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of its n-grams."""
    flat = _padded(text)
    grams = [buckets_of(flat[lo:lo + _PART + n - 1], n, buckets) for lo in range(0, len(flat), _PART) for n in _GRAMS]
    used, counts = np.unique(np.concatenate(grams), return_counts=True)
    return used, (counts / max(counts.sum(), 1)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _line(reached: np.ndarray, share: float) -> float:
    """What all but ``share`` of texts reach.  So rare a value lies below the lowest of fewer than 1 / ``share``
    texts: their line goes down by the log odds that are missing (a logistic tail)."""
    at = float(np.clip(np.quantile(reached, share), 0.001, 0.999))
    odds = at / (1 - at) * min(1.0, len(reached) * share)
    return odds / (1 + odds)


def train(sample: list[tuple[str, str]], *, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
          reject_share: float = REJECT_SHARE, seed: int = 7) -> Model:
    """Model of ``(language, text)`` rows; the order of the rows does not matter."""
    sample = sorted((lang, text.encode()) for lang, text in sample)
    names = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(seed)
    index = {name: i for i, name in enumerate(names)}
    embed = rng.uniform(-0.5, 0.5, (buckets, dimensions)).astype(np.float32) / np.float32(dimensions)
    linear = np.zeros((dimensions, len(names)), np.float32)
    seen = np.zeros(buckets, bool)
    kept_back = rng.random(len(sample)) < 0.2
    for name in names:  # each language is trained on at least one text
        own = [i for i, (lang, _) in enumerate(sample) if lang == name]
        kept_back[own[0]] = False
    rows = [(index[lang], text) for (lang, text), back in zip(sample, kept_back) if not back]
    bags = [_bag(text, buckets) for _, text in rows]

    def snippet(text: bytes) -> bytes:
        size = int(np.exp(rng.uniform(1.5, 6)))
        at = int(rng.integers(0, max(1, len(text) - size)))
        return text[at:at + size]

    steps, done = epochs * len(rows) * 2, 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, text = rows[i]
            for used, share in (bags[i], _bag(snippet(text), buckets)):
                rate = 2.0 * (1 - done / steps)
                done += 1
                mean = share @ embed[used]
                # How far the scores of this very text move per error; a step beyond it (one word repeated) diverges.
                moved = mean @ mean + 20 * (share @ share) * (linear * linear).sum()
                rate = np.float32(rate / max(1.0, rate * moved))
                error = _softmax(mean @ linear)
                error[label] -= 1
                back = linear @ error
                seen[used] = True
                linear -= rate * np.outer(mean, error)
                embed[used] -= (rate * np.float32(20)) * share[:, None] * back
    # Without a bias, and with nothing from n-grams never met, an unknown script scores the same everywhere.
    model = Model(names, np.concatenate((embed @ linear, np.ones((buckets, 1), np.float32)), 1) * seen[:, None])
    held = [(index[lang], text) for (lang, text), back in zip(sample, kept_back) if back] or rows
    # Whole texts alone would all be right and make every score 1; short pieces of them are not.
    whole, many = len(held), len(names)
    held += [(label, snippet(text)) for label, text in held for _ in range(3)]
    logits = np.array([share @ model.weights[used] for used, share in (_bag(t, buckets) for _, t in held)])
    known, logits = logits[:whole, many], logits[:, :many]
    truth = np.array([label for label, _ in held])
    trials = np.exp(np.linspace(0, 3, 31))  # never sharper than trained: no error in a sample is no proof
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in trials]
    model.temperature = float(trials[int(np.argmin(loss))])
    model.threshold = _line(_softmax(logits[:whole] / model.temperature).max(1), reject_share)
    model.familiar = _line(known, reject_share)
    return model


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def _predict(batches, model: Model | None):
    forget()
    for batch, data, starts in blocks(batches, _PART):
        best, score, rejected = judge(data, starts, model)
        yield table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": best,
                     "score": score, "rejected": rejected}, _OUT)


def _accepted(batches, model: Model | None, text_col: str):
    forget()
    for batch in batches:
        slim = pa.RecordBatch.from_arrays([batch.column(text_col).fill_null("")], names=["text"])
        kept = [~judge(data, starts, model)[2] for _, data, starts in blocks([slim], _PART)]
        if kept:
            yield batch.filter(pa.array(np.concatenate(kept)))


def accepted(docs: DataFrame, model: Model | None, *, text_col: str = "text", without_model: str = "keep") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is not rejected.

    Null texts and texts without a letter are rejected; repeated rows stay or go together; texts of any length are
    judged whole; an empty table gives an empty one.  Where no row had a label there is no model (``None``) and nothing
    tells languages apart: all rows are kept, unless ``without_model`` is ``"drop"``.
    """
    if model is None and without_model == "keep":
        return docs
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.mapInArrow(partial(_accepted, model=model, text_col=text_col), docs.schema)


def judge(data: np.ndarray, starts: np.ndarray, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a block."""
    many = len(starts) - 1
    raw, best, score, known = data.tobytes(), [UNKNOWN] * many, np.zeros(many), np.zeros(many)
    low = data | 32
    ascii_letter = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))))[starts]
    letters = np.diff(ascii_letter) > 0
    for i in np.flatnonzero(~letters & (np.diff(starts) > 0)):
        letters[i] = _has_letter(raw[starts[i]:starts[i + 1]])
    if model is not None and letters.any():
        flat = np.frombuffer(b" " + b"  ".join(raw[a:b].translate(_FOLD) for a, b in zip(starts[:-1], starts[1:])) + b" ", np.uint8)
        begin = starts[:-1] + 2 * np.arange(many)  # the blank before each text
        size = np.diff(starts) + 2
        sums = np.zeros((many, len(model.names) + 1))
        count = np.zeros(many)
        buckets = len(model.weights)
        for lo in range(0, len(flat), _PART):
            for n in _GRAMS:
                got = model.weights[buckets_of(flat[lo:lo + _PART + n - 1], n, buckets)]
                # Of each text the n-grams that begin in this part and end in the text.
                a = np.clip(begin - lo, 0, len(got))
                b = np.clip(begin + size - n + 1 - lo, 0, len(got))
                here = np.flatnonzero(a < b)
                edges = np.stack((a[here], b[here]), 1).ravel()
                if len(edges):
                    got = np.concatenate((got, np.zeros((1, got.shape[1]), np.float32)))
                    sums[here] += np.add.reduceat(got, edges)[::2]
                    count[here] += b[here] - a[here]
        mean = sums / np.maximum(count, 1)[:, None]
        known = mean[:, -1]
        chance = _softmax(mean[:, :-1] / model.temperature)
        top = chance.argmax(1)
        best = [model.names[t] if yes else UNKNOWN for t, yes in zip(top, letters)]
        score = np.where(letters, np.clip(chance[np.arange(many), top], 0, 1), 0.0)
    doubt = (score < model.threshold) | (known < model.familiar) if model is not None else np.ones(many, bool)
    return best, score, ~letters | doubt


def held_out(id_col) -> F.Column:
    """Rows never learned from: a null id, or crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each language, chosen by a hash of id and text; rows alike in both count once."""
    known = docs.where(~held_out(docs[id_col]) & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    known = known.select(known[lang_col].alias("lang"), known[text_col].alias("text"),
                         F.xxhash64(known[id_col], known[text_col]).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    # Of each language about a quarter more than wanted is drawn by the hash, then cut to the bound.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.25 * per_language + 20) / n))).otherwise(share)
    drawn = known.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return [(r["lang"], r["text"]) for r in drawn.withColumn("at", first).where(F.col("at") <= per_language).collect()]


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` per row, from the text alone.

    A null text and one without any letter are ``und`` with score 0 and rejected; so is every text where no
    model could be trained (``None``).  Repeated rows give repeated rows, null ids stay null, an empty table
    gives an empty one, other columns are not read.
    """
    slim = whole_texts(docs, id_col, text_col, held_out(docs[id_col]).alias("held_out"))
    return slim.mapInArrow(partial(_predict, model=model),
                           "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_model(docs: DataFrame, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang", **options) -> Model | None:
    """Model of the labelled rows that may be learned from; ``None`` if there are none."""
    sample = labelled_sample(docs, per_language, id_col, text_col, lang_col)
    return train(sample, **options) if sample else None
