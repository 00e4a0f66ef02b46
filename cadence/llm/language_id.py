"""Language identification by cross-parsing entropy.

From each language's labelled sample a suffix automaton is built. A text is
parsed greedily into the longest strings that occur in the sample: the
automaton is followed until no transition is left, which ends a phrase. Few
phrases mean that the sample explains the text well; phrases times the bits
needed to point into the sample, per symbol, estimate the cross entropy, and
the language with the smallest estimate wins (ties: the smaller name).

Texts are lower-cased, every run of other characters than letters is one
blank, and parsed whole. Blocks of ``BLOCK`` symbols are walked side by side,
so that thousands of blocks take a step together; where a phrase goes on from
one block into the next, the beginning of that one is parsed again from the
open phrase, so that the count is that of one parse. The automata's
transitions lie in one dense table per language in which a missing transition
already leads to the state after a restart, with the phrases that it ends in
its low bits: a step is one lookup.

The fit takes a bounded sample: at most ``sample_rows`` rows per language, at
most ``row_chars`` characters of each and ``sample_chars`` symbols in all, and
no more than lets all tables stay within ``TABLE_CELLS`` cells; a sample takes
even shares of its texts. Rows are
chosen by the hash of what would be learned from them, over all labelled rows;
equal hashes count once, so copies take one place and no language that has a
labelled text is left without a sample.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything if no row is labelled; rows without text or label are not
learned from; texts of any length are parsed whole; repeated rows get equal
answers; a null id is not held out; an empty table gives an empty result;
extra columns are kept by ``drop_unidentified`` and never read, and if no
language was learned it drops only rows without a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm._tables import discard, ready, stored
from cadence.llm._worker import begin

BLOCK = 256
TABLE_CELLS = 32_000_000
_LANES = 32_768
_CODES = 224
_OWN = 160
_BLANK = 1
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def lettered(text: str) -> bool:
    return bool(letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): letters in lower case, one 0 for each run of others."""
    low = [t.lower() for t in texts]
    offsets = np.append(0, np.cumsum([len(t) for t in low], dtype=np.int64)) if low else np.zeros(1, np.int64)
    a = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(letters()[a], a, 0)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    begin = offsets[:-1]
    keep[begin[begin < len(a)]] = True
    return a[keep], np.append(0, np.cumsum(keep))[offsets]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root."""
    next_, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(next_)
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = cur
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(next_)
                next_.append(dict(next_[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return next_


def step_table(symbols: np.ndarray, codes: int) -> np.ndarray:
    """(states x codes): the next state times 4, plus the phrases that the step ends."""
    states = suffix_automaton(symbols.tolist())
    root = np.full(codes, 1, np.int32)  # a symbol that the sample lacks is a phrase by itself
    for c, s in states[0].items():
        root[c] = 4 * s
    table = np.tile(root + 1, (len(states), 1))  # else the phrase ends and the next begins here
    table[0] = root
    for i, out in enumerate(states):
        for c, s in out.items():
            table[i, c] = 4 * s
    return table.reshape(-1)


def evenly(sizes: np.ndarray, most: int) -> int:
    """The largest size to which pieces can be cut so that together they do not exceed ``most``."""
    lo, hi = 0, int(sizes.max(initial=0))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if np.minimum(sizes, mid).sum() <= most else (lo, mid - 1)
    return lo


def sample_size(langs: int, codes: int, sample_chars: int) -> int:
    """Symbols that a language's sample may have."""
    return min(sample_chars, TABLE_CELLS // (2 * codes * max(langs, 1)))


class Model:
    """Languages' samples; the tables are built once in each worker."""

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = 65_536):
        self.langs = sorted(samples)
        parsed = {k: code_points(v) for k, v in samples.items()}
        points, counts = np.unique(np.concatenate([*(s for s, _ in parsed.values()), np.zeros(0, np.uint32)]), return_counts=True)
        points = points[np.argsort(-counts, kind="stable")]
        points = points[points > 0][:_OWN]
        self.own = points
        self.codes = 2 + len(points) + (_CODES - 2 - _OWN)
        most = sample_size(len(self.langs), self.codes, sample_chars)
        self.samples = {}
        for k, (symbols, offsets) in parsed.items():
            sizes = np.diff(offsets)
            place = np.arange(len(symbols)) - np.repeat(offsets[:-1], sizes)
            self.samples[k] = self.coded(symbols[place < evenly(sizes, most)])
        self._tables: list[np.ndarray] | None = None
        self._map: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_map": None}

    def coded(self, symbols: np.ndarray) -> np.ndarray:
        """1: blank, then the commonest letters, then classes of the others; 0 pads."""
        if getattr(self, "_map", None) is None:
            m = np.arange(0x110000, dtype=np.int64)
            m = 2 + len(self.own) + m % (_CODES - 2 - _OWN)
            m[0] = _BLANK
            m[self.own] = 2 + np.arange(len(self.own))
            self._map = m.astype(np.uint8)
        return self._map[symbols]

    def tables(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables = [step_table(self.samples[k], self.codes) for k in self.langs]
        return self._tables

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) numbers of phrases, and the symbols of each text.

        Texts are parsed in blocks side by side, each as if a phrase began with
        it; ``_joined`` then goes over the beginnings of those where one does not.
        """
        symbols, offsets = code_points(texts)
        coded = self.coded(symbols)
        size = np.diff(offsets)
        per = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), per)
        start = np.repeat(offsets[:-1] - BLOCK * (np.cumsum(per) - per), per) + BLOCK * np.arange(len(owner))
        stop = np.minimum(np.repeat(offsets[1:], per), start + BLOCK)
        first = np.diff(owner, prepend=-1) > 0
        last = np.append(first[1:], True)[:len(owner)]
        counts = np.zeros((len(self.langs), len(owner)), np.int32)
        ends = np.zeros((len(self.langs), len(owner)), np.int32)
        for at in range(0, len(owner), _LANES):
            s, e = start[at:at + _LANES], stop[at:at + _LANES]
            order = np.argsort(s - e, kind="stable")  # the longest blocks first: the others leave from the end
            s, e = s[order], e[order]
            n = len(s) - np.searchsorted((e - s)[::-1], np.arange(1, BLOCK + 1), side="left")
            grid = coded[np.minimum(s[None, :] + np.arange(BLOCK)[:, None], len(coded) - 1)].astype(np.int32)
            for k, table in enumerate(self.tables()):
                state = np.zeros(len(s), np.int32)
                count = np.zeros(len(s), np.int32)
                for step in range(BLOCK):
                    m = n[step]
                    if not m:
                        break
                    v = table[state[:m] * np.int32(self.codes) + grid[step, :m]]
                    count[:m] += v & 3
                    state[:m] = v >> 2
                counts[k, at + order], ends[k, at + order] = count, state
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables()):
            self._joined(table, coded, start, stop, first, counts[k], ends[k])
            counts[k] += last & (ends[k] > 0)
            out[:, k] = np.bincount(owner, counts[k], len(texts)).astype(np.int64)
        return out, size

    def _joined(self, table, coded, start, stop, first, count, end) -> None:
        """Correct ``count`` and ``end`` of the blocks at whose start the block before leaves a
        phrase open. Both parses of such a block run until they are in the same state,
        mostly a few phrases on; a block whose end changes passes that to the next."""
        began = np.zeros(len(start), np.int32)
        todo = np.flatnonzero(~first)
        while len(todo):
            todo = todo[end[todo - 1] != began[todo]]
            at, a, b, place = todo, began[todo], end[todo - 1], start[todo]
            began[todo] = b
            changed = []
            while len(at):
                c = coded[place]
                va, vb = table[a * np.int32(self.codes) + c], table[b * np.int32(self.codes) + c]
                count[at] += (vb & 3) - (va & 3)
                a, b, place = va >> 2, vb >> 2, place + 1
                open_ = a != b
                over = open_ & (place == stop[at])
                end[at[over]] = b[over]
                changed.append(at[over])
                on = open_ & ~over
                if not on.all():
                    at, a, b, place = at[on], a[on], b[on], place[on]
            todo = np.concatenate([*changed, np.zeros(0, np.int64)]).astype(np.int64) + 1
            todo = todo[todo < len(first)]
            todo = todo[~first[todo]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score): the score is 1 minus the best entropy over the second best, 1 with one language."""
        some = [i for i, t in enumerate(texts) if t and self.langs]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if some:
            found, _ = self.phrases([texts[i] for i in some])
            bits = found * np.log2([max(len(self.samples[k]), 2) for k in self.langs])
            best = bits.argmin(axis=1)
            for row, i in enumerate(some):
                if lettered(texts[i]):
                    b = bits[row]
                    rest = np.delete(b, best[row])
                    langs[i] = self.langs[best[row]]
                    scores[i] = float(1 - b[best[row]] / rest.min()) if len(rest) else 1.0
        return langs, scores


def fit(docs: DataFrame, train, sample_rows: int = 64, row_chars: int = 8192, sample_chars: int = 65_536,
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows where ``train`` holds and text and label are there."""
    ready(docs.sparkSession)
    part = F.substring(text_col, 1, row_chars)
    t = docs.filter(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(part).alias("h"), part.alias("t"))
    place = F.pmod("h", F.lit(1 << 30))
    texts = stored(t.select("lang", "h").distinct().withColumn("place", place), "sample-hashes")
    counts = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    # counts has a row per language, of which the driver gets sample_rows rows each; broadcast, it leaves the hashes
    # where they are, and of a language with many texts only a share of hashes that holds about twice the sample goes
    # on to the window
    share = (F.col("place") * F.col("n") <= F.lit(2.0 * sample_rows * (1 << 30))) | (F.col("place") == F.col("least"))
    first = Window.partitionBy("lang").orderBy("place", "h")
    # no more of a text than the sample of a language can hold, so that many labels give short samples
    take = min(row_chars, 64 + 4 * sample_size(counts.count(), _CODES, sample_chars))
    chosen = (texts.join(F.broadcast(counts), "lang").filter(share).withColumn("k", F.row_number().over(first))
              .filter(F.col("k") <= sample_rows).select("lang", "h", "k"))
    # no more rows than the sample that is collected below
    rows = t.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "k").agg(F.min(F.substring("t", 1, take)).alias("t")).collect()
    discard(texts)
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.k)):
        samples.setdefault(r.lang, []).append(r.t)
    return Model(samples, sample_chars)


def identify(model: Model, text):
    """Column of (lang, score) for a text column."""
    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("language_id")
        for texts in batches:
            langs, scores = [], []
            for at in range(0, len(texts), 1024):
                a, b = model.predict(texts.slice(at, 1024).to_pylist())
                langs += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(text)


def held_out(id_col: str = "doc_id"):
    """The rows kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text):
    """Column: whether a text column holds a letter."""
    @F.arrow_udf("boolean")
    def some(texts: pa.Array) -> pa.Array:
        begin("language_id")
        return pa.array([bool(t) and lettered(t) for t in texts.to_pylist()], pa.bool_())

    return some(text)


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is undetermined. A model that has
    learned no language is no verdict: then only rows without a letter go."""
    if not model.langs:
        return docs.filter(has_letter(F.col(text_col)))
    return docs.filter(identify(model, F.col(text_col))["lang"] != UNDETERMINED)
