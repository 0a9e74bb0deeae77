"""Secret scan: fixed patterns, and a linear-chain conditional random field that finds what they miss.

Base spans are the matches of three patterns.  The field tags each token of a text as begin, inside or
outside of a secret, from the token's shape, the words beside it, the signs between them and the file it
stands in, and is decoded by Viterbi.  Every token of every text is scored and takes part in the decoding.  Scores are
sums over features that repeat from place to place and are looked up; where they leave no doubt that the best
path is outside, a text is cut, and the runs between are decoded on their own, which is the decoding of the whole text.

The field is trained on the driver by stochastic gradient ascent on its likelihood, from at most
``sample_rows`` documents: base matches are the labels, and made-up secrets of public formats and harmless
look-alikes are put between their words.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from array import array
from dataclasses import dataclass
from functools import cache, partial
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.common import BATCH_ROWS, blocks, forget, spans_of, table, whole_texts

SAMPLE_ROWS = 600
EPOCHS = 4
FEATURES = 1 << 14
# Bytes of texts redacted together.
_REDACT_BYTES = 1 << 20
SEED = 11

KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_MIN_ASSIGN, _MIN_ACCESS, _MIN_HEX = 6, 20, 24
_LOWER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))

_CODE = np.arange(256)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LETTER = _UPPER | ((_CODE >= 97) & (_CODE <= 122))
_HEX = _DIGIT | ((_CODE >= 97) & (_CODE <= 102))
_TOKEN = _DIGIT | _LETTER | (_CODE >= 128) | np.isin(_CODE, list(b"+/_.-"))
_CODE_SIGN = np.isin(_CODE, list(b"={};<>"))
_WORD = re.compile(rb"[0-9A-Za-z+/_.\x80-\xff-]+")
_DIGITS, _UPPERS, _LETTERS = (bytes(np.flatnonzero(x).tolist()) for x in (_DIGIT, _UPPER, _LETTER))
_SIGNS = frozenset(b"+/_.-")
# How many values each part of a shape has.
_SHAPES = (8, 6, 5, 2, 4)
_SHAPE_CODES = 8 * 6 * 5 * 2 * 4
# Feature numbers of no word before and no word after.
_NO_WORD = zlib.crc32(b"before ") % FEATURES, zlib.crc32(b"after ") % FEATURES
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(flat: bytes, data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, secret start)`` of the base patterns in texts joined by line ends, sorted."""
    found = []
    low, places = flat.translate(_LOWER), []
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            places.append(at)
            at = low.find(word, at + 1)
    end = 0
    for at in sorted(places):  # every match begins with one of the words
        if at >= end and (m := _ASSIGN.match(flat, at)):
            end = m.end()
            if len(m[2]) >= _MIN_ASSIGN:
                found.append((at, 0, end, m.start(2)))
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(flat) if len(m[0]) >= _MIN_ACCESS]
    lo, hi = spans_of(_HEX[data])
    long = hi - lo >= _MIN_HEX
    found += [(a, 2, b, a) for a, b in zip(lo[long].tolist(), hi[long].tolist())]
    return sorted(found)


def _number(name: bytes) -> int:
    return zlib.crc32(name) % FEATURES


@cache
def _shape_facts(*shape: int) -> tuple[int, int]:
    """Feature number and number of a shape."""
    code = 0
    for value, many in zip(shape, _SHAPES):
        code = code * many + value
    return _number(b"shape %d %d %d %d %d" % shape), code


@cache
def _small(name: bytes) -> int:
    return _number(name)


def _word_facts(own: bytes) -> tuple[int, ...]:
    """Feature numbers of a token: five of its own, as the word before, as the word after; and the number of its shape."""
    size = len(own)
    digit = size - len(own.translate(None, _DIGITS))
    upper = size - len(own.translate(None, _UPPERS))
    letter = size - len(own.translate(None, _LETTERS))
    shape, code = _shape_facts(min(size.bit_length(), 7), digit * 5 // size, upper * 4 // size, min(letter - upper, 1), min(size - digit - letter, 3))
    kinds = set(own)
    signs = b"signs " if kinds.isdisjoint(_SIGNS) else b"signs " + bytes(sorted(kinds & _SIGNS))
    low = own.translate(_LOWER)
    return (_small(b"bias"), shape, _small(b"distinct %d %d" % (min(len(kinds) * 6 // min(size, 32), 6), min(size // 8, 5))),
            _number(b"head " + own[:4]), _small(signs), _number(b"before " + low[-16:]), _number(b"after " + low[:16]), code)


def _gap_facts(gap: bytes) -> tuple[int, ...]:
    """Feature numbers of the signs in front of a token and behind one, the last sign (256: none), and whether a line ends."""
    signs = gap.replace(b" ", b"")
    return _number(b"gap " + signs[-3:]), _number(b"tail " + signs[:2]), signs[-1] if signs else 256, b"\n" in gap


class _Met(dict):
    """Numbers of byte strings in the order they are met, and the facts of each."""

    def __init__(self, facts, width: int):
        super().__init__()
        self.facts, self.width, self.rows, self.size = facts, width, array("i"), 0

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.rows.extend(self.facts(key))
        self.size += len(key)
        return n

    def table(self) -> np.ndarray:
        return np.frombuffer(self.rows, np.int32).reshape(-1, self.width).astype(np.int64)


class Lexicon:
    """Tokens, and signs between them, that were met so far: their features are made once for all places they stand in."""

    def __init__(self):
        self.words, self.gaps = _Met(_word_facts, 8), _Met(_gap_facts, 4)
        self.pairs = np.full(_SHAPE_CODES * 257, -1, np.int64)

    def full(self) -> bool:
        return self.words.size + self.gaps.size > 16 << 20 or len(self.words) + len(self.gaps) > 1 << 18

    def pair_numbers(self, codes: np.ndarray) -> np.ndarray:
        """Feature numbers of shape and last sign of the gap together."""
        new = self.pairs[codes] < 0
        if new.any():
            for code in set(codes[new].tolist()):
                (rest, sign), shape = divmod(code, 257), []
                for many in reversed(_SHAPES):
                    rest, value = divmod(rest, many)
                    shape.append(value)
                self.pairs[code] = _number(b"shape, gap " + b"%d %d %d %d %d" % tuple(shape[::-1]) + (bytes([sign]) if sign < 256 else b""))
        return self.pairs[codes]


def line_of(data: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a line end before each and behind the last, and where each text begins there."""
    flat = b"\n".join([b"", *(data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])), b""])
    return flat, starts[:-1] + 1 + np.arange(len(starts) - 1)


class Tokens:
    """All tokens of texts (:func:`line_of`): where they stand, and by number what they and the signs around them are."""

    def __init__(self, flat: bytes, begins: np.ndarray, ends: np.ndarray, lexicon: Lexicon):
        joined = np.frombuffer(flat, np.uint8)
        self.lexicon = lexicon
        self.lo, self.hi = spans_of(_TOKEN[joined])
        self.doc = np.searchsorted(begins, self.lo, "right") - 1
        n = len(self.lo)
        self.word = np.fromiter(map(lexicon.words.__getitem__, _WORD.findall(flat)), np.int64, n)
        between = np.fromiter(map(lexicon.gaps.__getitem__, _WORD.split(flat)), np.int64, n + 1)
        self.gap, self.tail = between[:-1].copy(), between[1:].copy()
        edge = np.diff(self.doc, prepend=-1, append=len(begins)) != 0
        self.first, self.last = edge[:-1], edge[1:]
        # What stands in the texts before and behind has no say.
        for i in np.flatnonzero(self.first).tolist():
            self.gap[i] = lexicon.gaps[flat[begins[self.doc[i]] - 1:self.lo[i]]]
        for i in np.flatnonzero(self.last).tolist():
            self.tail[i] = lexicon.gaps[flat[self.hi[i]:ends[self.doc[i]] + 1]]
        self.file = np.array([_number(b"file " + file_features(joined[a:b])) for a, b in zip(begins, ends)], np.int64)

    def _neighbours(self, before, after, gaps, none_before, none_after):
        """What the words beside each token are worth, or nothing where a line ends between."""
        said = [np.concatenate((before[self.word[:1]], before[self.word[:-1]])), np.concatenate((after[self.word[1:]], after[self.word[:1]]))]
        said[0][gaps[self.gap, 3] > 0], said[1][gaps[self.tail, 3] > 0] = none_before, none_after
        return said

    def numbers(self) -> np.ndarray:
        """The feature numbers of each token, a row."""
        words, gaps = self.lexicon.words.table(), self.lexicon.gaps.table()
        before, after = self._neighbours(words[:, 5], words[:, 6], gaps, *_NO_WORD)
        pair = self.lexicon.pair_numbers(words[self.word, 7] * 257 + gaps[self.gap, 2])
        return np.column_stack((words[self.word, :5], before, after, gaps[self.gap, 0], gaps[self.tail, 1], self.file[self.doc], pair))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each tag for each token: the sums of the weights of its features."""
        words, gaps = self.lexicon.words.table(), self.lexicon.gaps.table()
        before, after = self._neighbours(weights[words[:, 5]], weights[words[:, 6]], gaps, *weights[list(_NO_WORD)])
        out = weights[words[:, :5]].sum(1)[self.word]
        out += before
        out += after
        out += weights[gaps[:, 0]][self.gap]
        out += weights[gaps[:, 1]][self.tail]
        out += weights[self.file][self.doc]
        out += weights[self.lexicon.pair_numbers(words[self.word, 7] * 257 + gaps[self.gap, 2])]
        return out

    def runs(self, scores: np.ndarray, steps: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens of one text among which the best path may leave the outside; around them it never does.

        A path with another tag at a token is compared with the same path with that tag outside (and an inside behind it
        a begin).  Where the second is better whatever the other tags, the token is outside in the best path: a text falls
        into runs that are decoded on their own, and this is the decoding of the whole text.
        """
        if not len(scores):
            return []
        ahead = np.full(len(scores), np.inf)
        ahead[:-1] = np.where(self.last[:-1], np.inf, scores[1:, BEGIN] - scores[1:, INSIDE])
        sure = np.ones(len(scores), bool)
        for tag in (BEGIN, INSIDE):
            change = (steps[:, OUT] - steps[:, tag]).min()
            stay = min(steps[OUT, c] - steps[tag, c] for c in (OUT, BEGIN))
            go_on = steps[OUT, BEGIN] - steps[tag, INSIDE] + (steps[BEGIN] - steps[INSIDE]).min() + ahead
            sure &= scores[:, OUT] - scores[:, tag] + change + np.minimum(stay, go_on) > 1e-6
        key = np.where(sure, 0, self.doc + 1)
        at = np.flatnonzero(np.diff(key, prepend=0, append=0))
        return [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if key[a]]


def file_features(data: np.ndarray) -> bytes:
    """How much of a file is digits and how much is signs of code, in steps."""
    size = max(len(data), 1)
    digits = int(np.count_nonzero(_DIGIT[data])) * 20 // size
    signs = int(np.count_nonzero(_CODE_SIGN[data])) * 50 // size
    return b"%d %d" % (min(digits, 5), min(signs, 5))


@dataclass
class Field:
    """Weights of features for each tag, and of neighbouring tags (rows: the tag before)."""

    weights: np.ndarray
    steps: np.ndarray


_NEVER = -1e4  # outside is never followed by inside


def viterbi(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """Best tags of a run between two outside tokens."""
    best = steps[OUT] + scores[0]
    back = []
    for row in scores[1:]:
        options = best[:, None] + steps
        back.append(options.argmax(0))
        best = options.max(0) + row
    tags = [int((best + steps[:, OUT]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def _expected(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags of the tokens and expected tag changes under the field (forward-backward, scaled at every token)."""
    own = np.exp(scores - scores.max(1, keepdims=True))
    moves = np.exp(steps)
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = moves.tolist()
    rows = own.tolist()
    ahead, scale, x, y, z = [], [], 1.0, 0.0, 0.0
    for e, f, g in rows:
        x, y, z = (x * oo + y * bo + z * io) * e, (x * ob + y * bb + z * ib) * f, (x * oi + y * bi + z * ii) * g
        c = 1 / (x + y + z)
        x, y, z = x * c, y * c, z * c
        ahead.append((x, y, z))
        scale.append(c)
    behind, x, y, z = [], oo, bo, io
    for (e, f, g), c in zip(reversed(rows), reversed(scale)):
        behind.append((x, y, z))
        e, f, g = e * x * c, f * y * c, g * z * c
        x, y, z = oo * e + ob * f + oi * g, bo * e + bb * f + bi * g, io * e + ib * f + ii * g
    ahead, behind = np.array(ahead), np.array(behind[::-1])
    tags = ahead * behind
    total = tags.sum(1, keepdims=True)
    tags /= total
    changes = np.zeros((3, 3))
    changes[OUT] += tags[0]
    changes[:, OUT] += tags[-1]
    changes += moves * (ahead[:-1].T @ (own[1:] * behind[1:] * np.array(scale)[1:, None] / total[1:]))
    return tags, changes


def _made_up(rnd: Random) -> tuple[str, str, str]:
    """Words before, secret, words after: secrets of public formats (fixed prefixes)."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, of=alnum: "".join(rnd.choice(of) for _ in range(n))
    kind = rnd.randrange(7)
    secret = ("ghp_" + some(36), "sk_live_" + some(24), f"xoxb-{some(12, '0123456789')}-{some(24)}", "AIza" + some(35, alnum + "_-"),
              f"eyJ{some(20)}.eyJ{some(40)}.{some(43, alnum + '_-')}", some(40, alnum + "+/"), some(rnd.randint(20, 48)))[kind]
    lead = rnd.choice(["key: ", "Authorization: Bearer ", "client_secret = ", "auth_key=", "credential: \"", "access_key='"])
    if kind < 5 and rnd.random() < 0.5:
        lead = ""
    return lead, secret, "\"" if lead.endswith("\"") else "'" if lead.endswith("'") else ""


def _harmless(rnd: Random) -> str:
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    return rnd.choice([
        lambda: f"20{number(2)}-0{rnd.randint(1, 9)}-1{number(1)}T1{number(1)}:00:00Z", lambda: f"https://{word()}.example.com/{word()}/{number(5)}?id={number(3)}",
        lambda: f"{word()}.{word()}{number(2)}@{word()}.org", lambda: f"+{number(2)}-{number(3)}-{number(7)}", lambda: f"{word()}-v{number(1)}.{number(2)}.{number(1)}",
        lambda: f"{word()}{word().title()}{word().title()}", lambda: f"{number(13)}", lambda: "".join(word() for _ in range(6)),
        lambda: f"src/{word()}/{word()}_{number(2)}.py", lambda: f"{number(3)}.{number(3)}.{number(1)}.{number(2)}", lambda: f"{word()}_{word()}_{number(2)}"])()


def _lesson(text: str, rnd: Random) -> tuple[bytes, list[tuple[int, int]]]:
    """A text with secrets and look-alikes put between its words, and where its secrets are (bytes)."""
    spaces = [m.start() for m in re.finditer(" ", text)]
    out, at, marks, size = [], 0, [], 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece.encode())
        size += len(out[-1])

    for place in sorted(rnd.sample(spaces, min(len(spaces), 6))):
        put(text[at:place] + " ")
        at = place
        if rnd.random() < 0.5:
            lead, secret, close = _made_up(rnd)
            put(lead)
            marks.append((size, size + len(secret)))
            put(secret + close)
        else:
            put(_harmless(rnd))
    put(text[at:])
    return b"".join(out), marks


def train(texts: list[str], *, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Field trained on texts; the same texts in any order give the same field."""
    rnd = Random(seed)
    lessons, lexicon = [], Lexicon()
    for text in sorted(texts) or ["a b c d e f g h"]:
        lesson, marks = _lesson(text, rnd)
        flat, begins = line_of(np.frombuffer(lesson, np.uint8), np.array([0, len(lesson)]))
        marks = sorted([(a + 1, b + 1) for a, b in marks] + [(secret, end) for _, _, end, secret in base_spans(flat, np.frombuffer(flat, np.uint8))])
        lexicon = Lexicon() if lexicon.full() else lexicon
        tokens = Tokens(flat, begins, begins + len(lesson), lexicon)
        if len(tokens.lo):
            opens, closes = np.array([(-1, -1), *marks]).T
            mark = np.searchsorted(opens, tokens.hi - 1, "right") - 1
            mark[closes[mark] <= tokens.lo] = 0
            goes_on = np.concatenate(([False], mark[1:] == mark[:-1]))
            lessons.append((tokens.numbers().astype(np.uint16), np.where(mark == 0, OUT, np.where(goes_on, INSIDE, BEGIN))))
    weights, steps = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    steps[OUT, INSIDE] = _NEVER
    seen, seen_steps = np.full((FEATURES, 3), 1e-6), np.full((3, 3), 1e-6)
    for _ in range(epochs):
        rnd.shuffle(lessons)
        for index, tags in lessons:
            belief, changes = _expected(weights[index].sum(1), steps)
            grad = -belief
            grad[np.arange(len(tags)), tags] += 1
            path = np.zeros((3, 3))
            np.add.at(path, ([OUT, *tags], [*tags, OUT]), 1)
            up = path - changes
            up[OUT, INSIDE] = 0
            flat = index.ravel()
            grad = np.column_stack([np.bincount(flat, np.repeat(g, index.shape[1]), FEATURES) for g in grad.T])
            seen += grad * grad
            weights += 0.3 * grad / np.sqrt(seen)
            seen_steps += up * up
            steps += 0.3 * up / np.sqrt(seen_steps)
    return Field(weights.astype(np.float32), steps)


def spans_in(data: np.ndarray, starts: np.ndarray, field: Field | None, lexicon: Lexicon | None = None) -> list[list[tuple[int, int, int]]]:
    """Of each text the sorted ``(start, kind, end)`` in bytes: base spans, and the field's beside them."""
    flat, begins = line_of(data, starts)
    spans = [(a, kind, b) for a, kind, b, _ in base_spans(flat, np.frombuffer(flat, np.uint8))]
    if field is not None:
        taken = sorted((a, b) for a, _, b in spans)
        firsts, lasts = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        tokens = Tokens(flat, begins, begins + np.diff(starts), lexicon or Lexicon())
        scores = tokens.scores(field.weights)
        for a, b in tokens.runs(scores, field.steps):
            tags = viterbi(scores[a:b], field.steps)
            i = 0
            while i < len(tags):
                j = i + 1
                if tags[i] == BEGIN:
                    while j < len(tags) and tags[j] == INSIDE:
                        j += 1
                    lo, hi = int(tokens.lo[a + i]), int(tokens.hi[a + j - 1])
                    while hi < len(flat) and flat[hi] == 61:  # padding
                        hi += 1
                    k = bisect.bisect_left(firsts, hi) - 1
                    if k < 0 or lasts[k] <= lo:
                        spans.append((lo, 3, hi))
                i = j
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    for a, kind, b in sorted(spans):
        doc = int(np.searchsorted(begins, a, "right")) - 1
        out[doc].append((a - int(begins[doc]), kind, b - int(begins[doc])))
    return out


def _characters(data: np.ndarray, spans):
    """The spans in code points instead of bytes."""
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(chars[a]), kind, int(chars[b])) for a, kind, b in spans]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                  ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])


def _scan(batches, field: Field | None):
    forget()
    lexicon = Lexicon()
    for batch, data, starts in blocks(batches):
        rows = []
        lexicon = Lexicon() if lexicon.full() else lexicon
        for doc, spans, a, b in zip(batch.column("doc_id").to_pylist(), spans_in(data, starts, field, lexicon), starts[:-1], starts[1:]):
            spans = _characters(data[a:b], spans) if spans else []
            said = [f"{KINDS[kind]}:{lo}:{hi}" for lo, kind, hi in spans]
            base = ",".join(s for s, (_, kind, _) in zip(said, spans) if kind < 3)
            n = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
            rows.append((doc, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), n[3]))
        yield table(dict(zip(_OUT.names, zip(*rows))), _OUT)


def field_of(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
             **options) -> Field:
    """Field trained on at most ``sample_rows`` documents, chosen by a hash of id and text.

    Rows alike in both are drawn once, so neither null nor repeated ids nor copies can fill the sample or exceed its bound.
    Null texts teach nothing; an empty table gives the field of no text.
    """
    many = max(docs.count(), 1)
    draw = F.xxhash64(docs[id_col], docs[text_col])
    share = min(1.0, (1.25 * sample_rows + 20) / many)
    near = F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = docs.where(near & docs[text_col].isNotNull()).groupBy(draw.alias("draw")).agg(F.min(docs[text_col]).alias("text"))
    return train([r["text"] for r in drawn.orderBy("draw").limit(sample_rows).collect()], **options)


def scan(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf`` per row; offsets in characters.

    ``spans`` lists ``kind:start:end`` by start, then kind.  The field (``None``: patterns alone) adds spans that
    do not touch a base span.  Null and empty texts have no spans; repeated rows give repeated rows; null ids stay
    null; an empty table gives an empty one; other columns are not read.
    """
    return whole_texts(docs, id_col, text_col).mapInArrow(
        partial(_scan, field=field),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def _redact(batches, field: Field | None, text_col: str, mark: bytes, size_col: str | None):
    forget()
    lexicon = Lexicon()
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        slim = pa.RecordBatch.from_arrays([batch.column(at).fill_null("")], names=["text"])
        fresh: list[str] = []
        changed = np.zeros(batch.num_rows, bool)
        row = 0
        for _, data, starts in blocks([slim], _REDACT_BYTES):
            lexicon = Lexicon() if lexicon.full() else lexicon
            for spans, a, b in zip(spans_in(data, starts, field, lexicon), starts[:-1], starts[1:]):
                if spans:
                    text, parts, end = data[a:b].tobytes(), [], 0
                    for lo, _, hi in spans:
                        if lo >= end:
                            parts += [text[end:lo], mark]
                        end = max(end, hi)
                    fresh.append(b"".join([*parts, text[end:]]).decode())
                    changed[row] = True
                row += 1
        if not fresh:
            yield batch
            continue
        columns, mask = list(batch.columns), pa.array(changed)
        columns[at] = pc.replace_with_mask(columns[at], mask, pa.array(fresh, columns[at].type))
        if size_col in batch.schema.names:
            k = batch.schema.get_field_index(size_col)
            columns[k] = pc.replace_with_mask(columns[k], mask, pa.array([len(t) for t in fresh], columns[k].type))
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redacted(docs: DataFrame, field: Field | None, *, text_col: str = "text", mark: str = "[secret]",
             size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span, base or the field's, replaced by ``mark``; all other columns and rows as they are.

    Where a text changes, ``size_col`` (if there is one) becomes its number of characters.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.mapInArrow(partial(_redact, field=field, text_col=text_col, mark=mark.encode(), size_col=size_col), docs.schema)
