"""Toxicity scoring of deobfuscated text (operator 4).

Noisy channel: what was meant, under a character language model, went through a channel that
writes letters as look-alikes (leetspeak), puts gaps between letters and repeats letters. Each
token with a look-alike beside a letter (on either side) or a letter twice in a row, and each run
of three or more single characters with gaps of one to three characters, enters a lattice of what
every character can stand for (itself, a letter, a boundary, nothing); Viterbi decoding finds the
likeliest path, and the model may choose the literal one. Elsewhere each character stands for
itself alone, so there is nothing to decode.

1. The language model counts trigrams, bigrams and single code points of the whole corpus, by
   tasks and then by a sum per cell. Those of a-z have cells of their own; all others are hashed
   into ``CELLS``, which bounds what the driver gets however many scripts the corpus holds.
2. Features are every restored word and every run of four characters in it or at its edges; in
   scripts without spaces every two neighbouring characters are a word. On at most
   ``SAMPLE_ROWS`` labelled training rows (lowest hash of doc_id; copies of a text once) a
   feature is kept if its likelihood ratio stands out among all features tested, and weighs its
   log odds. A word that the sample holds has its own weight, so a clean word isn't marked by the
   letters it shares with another; an unknown one has the mean over its strongest ``WINDOW``
   neighbouring runs.
3. A document's evidence is the soft maximum log(1 + sum(exp(weight) - 1)) over all its distinct
   words; a logistic curve fitted on the same sample turns it into a score.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1. Labels, lang, source and
doc_id never enter a score.

Defined results: a null or empty text has no evidence and scores by the curve's intercept;
rows without a doc_id count as held out; labels that are null, or of unknown documents, are not
used; with no usable label of either class every score is the sample's toxic share (0 without
rows); repeated rows score alike; other columns pass through, but for one named evidence or score,
which is replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, mix, release, small_batches, stage

#: Labelled training rows that are used, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Neighbouring character runs that an unknown word is judged by.
WINDOW = 4

# ---- code points ----------------------------------------------------------------------------

LETTER_BIT, SPACELESS_BIT, TOKEN_BIT, SIGN_BIT = 1, 2, 4, 8
#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han (fixed ranges).
SPACELESS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF),
             (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
SIGNS = "@$!|+(0123456789"
#: Between texts in a block: no run of single characters reaches across it.
APART = "\n" * 4


def code_classes() -> np.ndarray:
    """The class bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = LETTER_BIT | TOKEN_BIT
    for first, last in SPACELESS:
        out[first:last + 1][out[first:last + 1] > 0] |= SPACELESS_BIT
    for c in SIGNS:
        out[ord(c)] |= SIGN_BIT | TOKEN_BIT
    out[ord("_")] |= TOKEN_BIT
    return out


CLASSES = code_classes()
CLASS_OF = CLASSES.tobytes()  # the same, for single characters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(column: pa.ChunkedArray) -> tuple[str, np.ndarray]:
    """All texts in lower case with ``APART`` before and after each, and where each begins."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    begins = np.cumsum([len(APART)] + [len(t) + len(APART) for t in texts])
    return APART + APART.join(texts) + APART, begins.astype(np.int64)


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of ``flag``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


# ---- character language model ---------------------------------------------------------------

#: a-z and the boundary have exact trigram cells; other trigrams share the rest by hash.
EXACT = 27 ** 3
CELLS = 1 << 20
PAIRS, SINGLES = 1 << 18, 1 << 16


def symbols(codes: np.ndarray) -> np.ndarray:
    """0 is a boundary, 1-26 are a-z, other letters keep their code point."""
    out = np.where(CLASSES[codes] & LETTER_BIT, codes, 0).astype(np.int64)
    latin = (out >= 97) & (out <= 122)
    out[latin] -= 96
    return out


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        h = mix(h * np.uint64(31) + part.astype(np.uint64))
    return (h >> np.uint64(1)).astype(np.int64)


def trigram_cells(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = (a * 27 + b) * 27 + c
    far = np.flatnonzero((a > 26) | (b > 26) | (c > 26))
    out[far] = EXACT + mixed(a[far], b[far], c[far]) % (CELLS - EXACT)
    return out


def pair_cells(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = b * 27 + c
    far = np.flatnonzero((b > 26) | (c > 26))
    out[far] = 729 + mixed(b[far], c[far]) % (PAIRS - 729)
    return out


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    three, two, one = (np.zeros(n, np.int64) for n in (CELLS, PAIRS, SINGLES))
    for table in blocks(batches, "text"):
        text, _ = joined(table.column("text"))
        s = symbols(code_points(text))
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # a gap is one boundary
        if len(s) > 2:
            for total, cell in ((three, trigram_cells(s[:-2], s[1:-1], s[2:])),
                                (two, pair_cells(s[1:-1], s[2:])), (one, s[2:] % SINGLES)):
                n = np.bincount(cell)
                total[:len(n)] += n
    total = np.concatenate([three, two, one])
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])


def language_model(documents: DataFrame) -> np.ndarray:
    """Counts by cell over all texts of ``documents``: trigrams, pairs, single symbols."""
    small_batches(documents.sparkSession)
    found = (documents.select("text").mapInArrow(lean(count_batches), "cell bigint, n bigint")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(CELLS + PAIRS + SINGLES, np.float32)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return counts


class Model:
    """-log P(symbol | two before), interpolated: a list for a-z, others when asked for."""

    def __init__(self, counts: np.ndarray, memory: int = 200_000):
        self.three, self.two, self.one = np.split(counts, [CELLS, CELLS + PAIRS])
        self.total = max(float(self.one.sum()), 1.0)
        a, b, c = (x.ravel() for x in np.indices((27, 27, 27)))
        self.latin = self.costs(a, b, c).tolist()
        self.known: dict[tuple[int, int, int], float] = {}
        self.memory = memory

    def costs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        one = self.one[c % SINGLES] / self.total
        two = self.two[pair_cells(b, c)] / np.maximum(self.one[b % SINGLES], 1)
        three = self.three[trigram_cells(a, b, c)] / np.maximum(self.two[pair_cells(a, b)], 1)
        return -np.log(0.75 * np.minimum(three, 1) + 0.2 * np.minimum(two, 1) + 0.04 * one
                       + 0.01 / 64)

    def cost(self, a: int, b: int, c: int) -> float:
        if a < 27 and b < 27 and c < 27:
            return self.latin[(a * 27 + b) * 27 + c]
        got = self.known.get((a, b, c))
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            got = self.known[a, b, c] = float(
                self.costs(*(np.array([x], np.int64) for x in (a, b, c)))[0])
        return got


# ---- channel and decoding -------------------------------------------------------------------

#: Letters that a character can stand for (fixed values).
LOOKALIKES = {
    "4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "il", "!": "il",
    "|": "li", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z",
}
#: What the channel costs. A sign is rarely meant as itself inside a word, but a bracket before
#: one and a mark after one are usual; a letter written twice is rarely a slip, a third one is.
SUBSTITUTED, LITERAL, DOUBLED, REPEATED = 1.0, 7.0, 5.0, 0.5
OPENING, CLOSING, CLOSING_OTHER = {"(": 0.0}, {"!": 0.0, "(": 0.0}, 6.0
#: A gap between single characters is a boundary if it is wider than the narrowest one.
JOINED, UNLIKELY = 0.2, 2.0


def symbol_of(letter: str) -> int:
    code = ord(letter)
    if not CLASS_OF[code] & LETTER_BIT:
        return 0
    return code - 96 if 97 <= code <= 122 else code


SIGN_ARCS = {sign: [(x, symbol_of(x), SUBSTITUTED) for x in meant]
             for sign, meant in LOOKALIKES.items()}


def lattice(stretch: str) -> list[list[tuple[str, int, float]]]:
    """For each character (each gap in a run of single ones) what it can stand for, its symbol
    and the channel's cost."""
    out: list[list[tuple[str, int, float]]] = []
    word_end = len(stretch.rstrip(SIGNS))
    kinds = [CLASS_OF[ord(c)] & (LETTER_BIT | SIGN_BIT) for c in stretch]
    narrow = min((len(list(g)) for kind, g in groupby(kinds) if not kind), default=0)
    k = 0
    while k < len(stretch):
        c = stretch[k]
        again = 0.0
        if k and stretch[k - 1] == c:
            more = (k > 1 and stretch[k - 2] == c) or stretch[k + 1:k + 2] == c
            again = REPEATED if more else DOUBLED
        if kinds[k] & LETTER_BIT:
            arcs = [(c, symbol_of(c), 0.0)]
            if again:
                arcs.append(("", 0, again))
        elif kinds[k]:
            literal = LITERAL
            if k == 0:
                literal = OPENING.get(c, LITERAL)
            elif k >= word_end:
                literal = CLOSING.get(c, CLOSING_OTHER)
            arcs = SIGN_ARCS[c] + [(c, 0, literal)]
            if again:
                arcs.append(("", 0, again))
        else:
            start = k
            while k + 1 < len(stretch) and not kinds[k + 1]:
                k += 1
            wide = k + 1 - start > narrow
            arcs = [(" ", 0, 0.0 if wide else UNLIKELY), ("", 0, UNLIKELY if wide else JOINED)]
        out.append(arcs)
        k += 1
    return out


def decode(stretch: str, model: Model) -> str:
    """The likeliest restored text of a stretch (Viterbi; a state is the last two symbols)."""
    latin, cost = model.latin, model.cost
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for arcs in lattice(stretch):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for state, (spent, path) in states.items():
            a, b = state
            for letter, s, channel in arcs:
                key, total = state, spent + channel
                if letter and (s or b):  # a boundary after a boundary changes nothing
                    key = (b, s)
                    if a < 27 and b < 27 and s < 27:
                        total += latin[(a * 27 + b) * 27 + s]
                    else:
                        total += cost(a, b, s)
                old = following.get(key)
                if old is None or total < old[0]:
                    following[key] = (total, (letter, path) if letter else path)
        states = following
    _, path = min(((spent + (cost(a, b, 0) if b else 0.0), path)
                   for (a, b), (spent, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def stretches(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where something may be disguised: tokens with a sign beside a letter or a letter twice
    in a row, and runs of single characters."""
    bits = CLASSES[codes]
    letter, sign = (bits & LETTER_BIT) > 0, (bits & SIGN_BIT) > 0
    begin, end = runs((bits & TOKEN_BIT) > 0)
    if not len(begin):
        return begin, end
    odd = np.zeros(len(codes), bool)
    odd[1:] = ((sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:])
               | (letter[1:] & (codes[1:] == codes[:-1])))
    marked = np.zeros(len(begin), bool)
    marked[np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1] = True
    marks = np.concatenate([[0], np.cumsum(codes == ord("!"))])
    single = ((marks[end] - marks[begin + 1] == end - begin - 1)  # one, and marks after it
              & (codes[begin] != ord("_")))
    near = np.zeros(len(begin), bool)
    near[1:] = single[1:] & single[:-1] & (begin[1:] - end[:-1] <= 3)
    # a run of neighbours is a maximal stretch of tokens each near the one before
    first, last = runs(near)
    first = first - 1
    some = np.concatenate([[0], np.cumsum(letter)])
    long = (last - first >= 3) & (some[end[last - 1]] > some[begin[first]]) if len(first) \
        else np.zeros(0, bool)
    first, last = first[long], last[long]
    inside = np.zeros(len(begin) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    alone = marked & (np.cumsum(inside)[:-1] == 0)
    begins = np.concatenate([begin[alone], begin[first]])
    ends = np.concatenate([end[alone], end[last - 1]])
    order = np.argsort(begins, kind="stable")
    return begins[order], ends[order]


class Restorer:
    """Decodes stretches; equal short ones once in a while (the memory is bounded)."""

    def __init__(self, counts: np.ndarray, memory: int = 50_000):
        self.model, self.known, self.memory = Model(counts), {}, memory

    def stretch(self, text: str) -> str:
        got = self.known.get(text)
        if got is None:
            got = decode(text, self.model)
            if len(text) <= 64:
                if len(self.known) >= self.memory:
                    self.known.clear()
                self.known[text] = got
        return got

    def block(self, text: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the restored ``text`` and where its documents begin now."""
        codes = code_points(text)
        pieces, where, grown, done = [], [], [], 0
        known = self.known
        for i, j in zip(*(x.tolist() for x in stretches(codes)), strict=True):
            found = text[i:j]
            got = known.get(found)
            if got is None:
                got = self.stretch(found)
            if got != found:
                pieces.append(text[done:i])
                pieces.append(got)
                where.append(j)
                grown.append(len(got) - (j - i))
                done = j
        if not where:
            return codes, begins
        pieces.append(text[done:])
        shift = np.concatenate([[0], np.cumsum(grown)])
        return (code_points("".join(pieces)),
                begins + shift[np.searchsorted(where, begins, side="right")])

    def text(self, text: str) -> str:
        column = pa.chunked_array([pa.array([text])])
        codes, begins = self.block(*joined(column))
        codes = codes[begins[0]:begins[1] - len(APART)]
        return codes.tobytes().decode("utf-32-le", "surrogatepass")


# ---- features ------------------------------------------------------------------------------

STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of words and their hashes (even numbers)."""
    bits = CLASSES[codes]
    spaceless = (bits & SPACELESS_BIT) > 0
    begin, end = runs(((bits & LETTER_BIT) > 0) & ~spaceless)
    if spaceless.any():
        b, e = runs(spaceless)
        pair = np.flatnonzero(spaceless[:-1] & spaceless[1:])
        one = b[e - b == 1]
        begin = np.concatenate([begin, pair, one])
        end = np.concatenate([end, pair + 2, one + 1])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    if not len(begin):
        return begin, end, np.zeros(0, np.int64)
    n = len(codes)
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, STEP)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BACK)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes.astype(np.uint64) + STEP)
                                                     * up[:-1])])
    value = mix((sums[end] - sums[begin]) * down[begin])
    return begin, end, (value & ~np.uint64(1)).view(np.int64)


def character_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (odd numbers) of all runs of four characters whose middle two are
    letters of a script with spaces; anything else than such a letter is one boundary."""
    bits = CLASSES[codes]
    y = np.where((bits & (LETTER_BIT | SPACELESS_BIT)) == LETTER_BIT, codes, 0).astype(np.uint64)
    if len(y) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((y[1:-2] > 0) & (y[2:-1] > 0))
    # 21 bits a code point: four don't fit into 64 bits, so the outer two are mixed in
    value = mix(mix(y[at] << np.uint64(21) | y[at + 1])
                + (y[at + 2] << np.uint64(21) | y[at + 3]) * STEP)
    return at, (value | np.uint64(1)).view(np.int64)


def feature_batches(batches: Iterator[pa.RecordBatch],
                    counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents hold each feature, per block."""
    restorer = Restorer(counts)
    for table in blocks(batches, "text"):
        codes, begins = restorer.block(*joined(table.column("text")))
        begin, _, word = words(codes)
        at, run = character_runs(codes)
        place, feature = np.concatenate([begin, at + 1]), np.concatenate([word, run])
        yield per_class(np.searchsorted(begins, place, side="right") - 1, feature, table)


def per_class(doc: np.ndarray, feature: np.ndarray, table: pa.Table) -> pa.RecordBatch:
    """Documents of either class that hold each feature."""
    toxic = np.asarray(table.column("toxic").combine_chunks()).astype(np.int64)
    values, which = np.unique(feature, return_inverse=True)
    pair = np.unique(which.reshape(-1) * len(toxic) + doc)
    which, doc = pair // len(toxic), pair % len(toxic)
    n = np.bincount(which, minlength=len(values))
    n1 = np.bincount(which, weights=toxic[doc], minlength=len(values)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(values), pa.array(n1), pa.array(n - n1)], ["feature", "n1", "n0"])


class Weights:
    """Weights by feature; a small table of bits answers most questions."""

    def __init__(self, known: np.ndarray, weights: np.ndarray):
        self.known, self.weights = known, weights
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.slot(known)] = True

    @staticmethod
    def slot(features: np.ndarray) -> np.ndarray:
        return (features.view(np.uint64) >> np.uint64(44)).astype(np.int64)

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``features`` are known, and their weights."""
        at = np.flatnonzero(self.bits[self.slot(features)])
        if not len(at):
            return at, np.zeros(0)
        slot = np.minimum(np.searchsorted(self.known, features[at]), len(self.known) - 1)
        hit = self.known[slot] == features[at]
        return at[hit], self.weights[slot[hit]]


def word_weights(codes: np.ndarray, weights: Weights):
    """Begins and hashes of words, their weights, and whether the sample's weight was used."""
    begin, end, word = words(codes)
    out, own = np.zeros(len(begin)), np.zeros(len(begin), bool)
    at, weight = weights.find(word)
    out[at], own[at] = weight, True
    place, run = character_runs(codes)
    hot, weight = weights.find(run)
    if not len(hot) or not len(begin):
        return begin, word, out, own
    sums = np.zeros(len(codes) + 1)
    sums[place[hot] + 1] = weight
    sums = np.cumsum(sums)
    # a word from b to e has runs that start from b - 1 to e - 3
    w = np.searchsorted(begin, place[hot] + 1, side="right") - 1
    free = ~own[w]
    w, start = w[free], place[hot][free]
    low, high = begin[w] - 1, end[w] - 2
    width = np.minimum(WINDOW, high - low)
    for shift in range(WINDOW):
        left = np.clip(start - shift, low, high - width)
        np.maximum.at(out, w, (sums[left + width] - sums[left]) / width)
    return begin, word, out, own


def unsure_batches(batches: Iterator[pa.RecordBatch], counts: np.ndarray, known: np.ndarray,
                   weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of either class for each word that is judged by its character runs."""
    restorer, table_of = Restorer(counts), Weights(known, weights)
    for table in blocks(batches, "text"):
        codes, begins = restorer.block(*joined(table.column("text")))
        begin, word, weight, own = word_weights(codes, table_of)
        hit = (weight > 0) & ~own
        yield per_class(np.searchsorted(begins, begin[hit], side="right") - 1, word[hit], table)


def evidence(codes: np.ndarray, begins: np.ndarray, weights: Weights) -> np.ndarray:
    """The soft maximum of the weights of each document's distinct words."""
    docs = len(begins) - 1
    begin, word, weight, _ = word_weights(codes, weights)
    hit = np.flatnonzero(weight > 0)
    if not len(hit):
        return np.zeros(docs)
    doc = np.searchsorted(begins, begin[hit], side="right") - 1
    word, weight = word[hit], weight[hit]
    order = np.lexsort((word, doc))
    doc, word, weight = doc[order], word[order], weight[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])
    return np.log1p(np.bincount(doc[new], weights=np.expm1(weight[new]), minlength=docs))


def score_batches(batches: Iterator[pa.RecordBatch], counts: np.ndarray, known: np.ndarray,
                  weights: np.ndarray, keep_text: bool = False) -> Iterator[pa.RecordBatch]:
    restorer, table_of = Restorer(counts), Weights(known, weights)
    for table in blocks(batches, "text"):
        codes, begins = restorer.block(*joined(table.column("text")))
        columns = {n: table.column(n) for n in table.column_names
                   if n not in ("text", "evidence")}
        if keep_text:
            columns["text"] = table.column("text")
        columns["evidence"] = pa.array(evidence(codes, begins, table_of))
        yield from pa.table(columns).to_batches()


# ---- fitting -------------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak pull of the slope to 0 and the prior
    of half a row more of either class."""
    slope, base = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + base, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.1 * slope, (y - p).sum() - 0.01 * base])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()],
                      [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, base = slope + step[0], base + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(slope, 0.0)), float(base)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Language model, feature weights and curve, from all texts and the labelled sample."""
    spark = documents.sparkSession
    cost = language_model(documents)
    shared = spark.sparkContext.broadcast(cost)
    chosen = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
              .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    sample = stage(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                   .withColumn("mark", F.xxhash64("text"))
                   .dropDuplicates(["mark", "toxic"]).select("doc_id", "toxic", "text"), "sample")
    model = {"cost": cost, "features": np.zeros(0, np.int64), "weights": np.zeros(0),
             "slope": 0.0, "base": -30.0}
    size = sample.groupBy("toxic").count().collect()
    sizes = {r["toxic"]: r["count"] for r in size}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        model["base"] = math.log((share + 1e-9) / (1 - share + 1e-9))
        return model
    counts = stage(sample.select("toxic", "text").mapInArrow(
        lean(lambda b: feature_batches(b, shared.value)), "feature bigint, n1 bigint, n0 bigint")
        .groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "features")
    tested = counts.count()
    odds = F.log((F.col("n1") + 0.5) / (toxic + 1.0)) - F.log((F.col("n0") + 0.5) / (clean + 1.0))
    n = F.col("n1") + F.col("n0")
    share = toxic / (toxic + clean)

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("n1"), n * share) + term(F.col("n0"), n * (1 - share)))
    kept = (counts.select("feature", odds.alias("w"), ratio.alias("g"))
            .where((F.col("w") > 0) & (F.col("g") > 2 * math.log(max(tested, 2)) + 4))
            .select("feature", "w").toArrow())
    found, strong = kept.column("feature").to_numpy(), kept.column("w").to_numpy()
    order = np.argsort(found)
    found, strong = found[order], strong[order]
    # words with such character runs that the sample holds are weighed by themselves
    unsure = (sample.select("toxic", "text").mapInArrow(
        lean(lambda b: unsure_batches(b, shared.value, found, strong)),
        "feature bigint, n1 bigint, n0 bigint")
        .groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .select("feature", F.greatest(odds, F.lit(0.0)).alias("w")).toArrow())
    features = np.concatenate([found, unsure.column("feature").to_numpy()])
    weights = np.concatenate([strong, unsure.column("w").to_numpy()])
    order = np.argsort(features)
    known, weights = features[order], weights[order]
    model["features"], model["weights"] = known, weights
    points = sample.select("toxic", "text").mapInArrow(
        lean(lambda b: score_batches(b, shared.value, known, weights)),
        "toxic int, evidence double").collect()
    x = np.array([r["evidence"] for r in points])
    y = np.array([r["toxic"] for r in points], float)
    model["slope"], model["base"] = logistic(x, y)
    release(sample, counts)
    return model


def score_documents(documents: DataFrame, model: dict, keep_text: bool = False) -> DataFrame:
    """``documents`` (the text only if ``keep_text``) with ``score``; other columns pass
    through, and one named evidence or score is replaced."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(
        (model["cost"], model["features"], model["weights"]))
    rest = [f for f in documents.schema if f.name not in ("text", "evidence", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
                       + ["text string"] * keep_text + ["evidence double"])
    found = documents.select(*[F.col(f"`{f.name}`") for f in rest], "text").mapInArrow(
        lean(lambda b: score_batches(b, *shared.value, keep_text)), schema)
    logit = F.lit(model["slope"]) * F.col("evidence") + F.lit(model["base"])
    return found.withColumn("score", 1 / (1 + F.exp(-logit))).drop("evidence")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, over whole texts."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    small_batches(spark)
    scored = score_documents(documents, fit(documents, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
