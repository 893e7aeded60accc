"""Operator 3: byte-level BPE encoding and decoding by a table of ranks.

Bytes become Latin-1 characters so that one run of an Aho-Corasick automaton over many pieces, set apart by a
character that is no byte, gives each piece's leftmost longest entries. Two entries may stand next to each other
if merging, run on their bytes together, would end with exactly those two; that test is memoised by pair. Pieces
whose longest entries all fit are done. The others are walked from their first misfit on: the next shorter entry
is tried, and a position from which no entry leads on is marked and never tried again, so each position is given
up at most once and the walk is linear in the piece (the longest entry is a constant). The result is that of
merging by rank, without merging.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from vaultspark.llm.common import give_back

#: Unicode White_Space, which is what \s means to the tokenizer's own regular expressions.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Pieces never cross these runs: a word before one of these marks, anything with one space before it, or white space.
#: A piece that holds a letter or a number holds no such mark, so a word's border to one is always a piece's border.
CHUNK = re.compile(rf" ?[^\W_]++(?=[.,!?;:])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Bounds of the memos: runs in one of two generations, their length, pairs in order, pairs met while walking.
MEMO_RUNS, MEMO_LENGTH, MEMO_PAIRS, MEMO_WALK = 480_000, 64, 400_000, 200_000
RUNS_AT_ONCE = 50_000  # runs that are Python objects at one time
AT_ONCE = 1 << 17  # ids decoded together
SLICE_BYTES = 4_000_000  # bytes of text whose results are one batch
NEVER = 1 << 60


class Runs:
    """Ids of runs in one array: a dictionary from the run to its number, and where each number's ids begin."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.starts, self.sizes, self.ids, self.many, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32), 0, 0

    def add(self, names: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Takes runs up, their ids one after another in `ids`."""
        many, used = self.many + len(names), self.used + len(ids)
        if many > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(many, x.dtype)]) for x in (self.starts, self.sizes))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(used, np.int32)])
        self.starts[self.many : many] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.many : many] = sizes
        self.ids[self.used : used] = ids
        self.number.update(zip(names, range(self.many, many)))
        self.many, self.used = many, used

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size of each numbered run, their ids one after another)."""
        sizes = self.sizes[numbers].astype(np.int64)
        return sizes, self.ids[spread(self.starts[numbers], sizes)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the same for the next."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Vocabulary:
    """Ranks, their splits, and the encoder over them. `ranks` maps bytes to ids, smaller ids merging first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        many = max(ranks.values(), default=-1) + 1
        self.ids = {raw.decode("latin-1"): i for raw, i in ranks.items()}
        self.pieces = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        by_id = [b""] * many
        for raw, i in ranks.items():
            by_id[i] = raw
        self.length = [len(raw) for raw in by_id]
        self.lengths = np.array(self.length, np.int64)
        self.data, self.at = np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(self.lengths) - self.lengths
        #: The two entries that an entry is merged from (itself, if from none) and the entry of two, by both.
        self.left, self.right = np.arange(many), np.arange(many)
        self.merged: dict[int, int] = {}
        self.walked: dict[int, bool] = {}
        self.automaton, usable = ahocorasick.Automaton(), {}
        for text, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(text) > 1:
                for k in range(1, len(text)):
                    left, right = self.ids.get(text[:k], i), self.ids.get(text[k:], i)
                    if left < i and right < i and self._fits(left, right):
                        self.left[i], self.right[i], self.merged[left << 20 | right] = left, right, i
                        break
                else:
                    continue  # merging never makes it; only a whole piece can be this entry
            self.automaton.add_word(text, i)
            usable[text] = i
        if usable:
            self.automaton.make_automaton()
        #: The longest entry that starts an entry, or -1: what to try after it.
        self.shorter = [-1] * many
        for text, i in usable.items():
            self.shorter[i] = next((j for k in range(len(text) - 1, 0, -1) if (j := usable.get(text[:k], -1)) >= 0), -1)
        self.walked.clear()
        order = sorted(self.merged.items())
        self.across = np.array([k for k, _ in order] + [NEVER], np.int64), np.array([i for _, i in order] + [NEVER], np.int64)
        self.pairs, self.fit = np.empty(0, np.int64), np.empty(0, bool)
        self.new, self.old = Runs(), Runs()

    def _fits(self, left: int, right: int) -> bool:
        """Would merging by rank leave left | right as they are, given bytes(left) + bytes(right)?

        Undo the later of the two entries' last merges, again and again, watching only the pair that touches
        the border: a merge across it that comes before the undone one would have come first.
        """
        key = left << 20 | right
        known = self.walked.get(key)
        if known is not None:
            return known
        a, b, before, answer = left, right, NEVER, True
        while True:
            if self.merged.get(a << 20 | b, NEVER) < before:
                answer = False
                break
            a_last, b_first = int(self.right[a]), int(self.left[b])
            if a_last == a and b_first == b:
                break
            # At equal ranks the left one merges first, so the right one is undone first.
            if b_first == b or a_last != a and a > b:
                before, a = a, a_last
            else:
                before, b = b + 1, b_first
        if len(self.walked) >= MEMO_WALK:
            self.walked.clear()
        self.walked[key] = answer
        return answer

    def _all_fit(self, keys: np.ndarray) -> np.ndarray:
        """_fits for many pairs left << 20 | right, through the memo of pairs."""
        unique, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, unique), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == unique if len(self.pairs) else np.zeros(len(unique), bool)
        answer = np.ones(len(unique), bool)
        answer[known] = self.fit[at[known]]
        live = np.flatnonzero(~known)
        a, b, before = unique >> 20, unique & (1 << 20) - 1, np.full(len(unique), NEVER)
        while len(live):
            x, y = a[live], b[live]
            across = x << 20 | y
            at = np.searchsorted(self.across[0], across)
            merge = np.where(self.across[0][at] == across, self.across[1][at], NEVER)
            bad = merge < before[live]
            answer[live[bad]] = False
            x_last, y_first = self.right[x], self.left[y]
            ends = bad | (x_last == x) & (y_first == y)
            undo_left = (y_first == y) | (x_last != x) & (x > y)
            before[live] = np.where(undo_left, x, y + 1)
            a[live], b[live] = np.where(undo_left, x_last, x), np.where(undo_left, y, y_first)
            live = live[~ends]
        if len(self.pairs) + int((~known).sum()) > MEMO_PAIRS:
            self.pairs, self.fit = unique[:MEMO_PAIRS], answer[:MEMO_PAIRS]
        elif not known.all():
            pairs = np.concatenate([self.pairs, unique[~known]])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fit = pairs[order], np.concatenate([self.fit, answer[~known]])[order]
        return answer[back]

    def _walk(self, text: str, out: list[int], good: int) -> list[int]:
        """Ids of a piece, given its leftmost longest entries, of which the first `good` fit each other."""
        n, longest, second = len(text), self.automaton.iter_long, itemgetter(1)
        known, fits, length, shorter = self.walked.get, self._fits, self.length, self.shorter
        further = iter(out[good + 1 :])  # longest entries one after another, as long as each is taken
        i, pos = out[good], 0
        del out[good:]
        for x in out:
            pos += length[x]
        first, dead = True, bytearray(n + 1)
        while True:
            last = out[-1] if out else -1
            while i >= 0:
                end = pos + length[i]
                if not dead[end]:
                    if last < 0:
                        break
                    fit = known(last << 20 | i)
                    if fits(last, i) if fit is None else fit:
                        break
                i = shorter[i]
                first = False
            if i >= 0:
                out.append(i)
                pos = end
                if pos == n:
                    return out
                if not first:
                    further, first = map(second, longest(text, pos)), True
                i = next(further)
            else:
                dead[pos] = 1
                last = out.pop()
                i, pos, first = shorter[last], pos - length[last], False

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, the ids one after another); pieces are Latin-1 of their bytes and not empty."""
        sizes_in = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes_in + 1)
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long("Ā".join(pieces))), np.int64).reshape(-1, 2) if self.ids else np.empty((0, 2), np.int64)
        owner, ids = np.searchsorted(ends, found[:, 0], side="right"), found[:, 1]
        if np.any(np.bincount(owner, weights=self.lengths[ids], minlength=len(pieces)) != sizes_in):
            raise ValueError("a byte of the text is not in the vocabulary")
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        misfit = inner[~self._all_fit(ids[inner] << 20 | ids[inner + 1])]
        bad, first = np.unique(owner[misfit], return_index=True)
        starts = np.searchsorted(owner, np.arange(len(pieces) + 1))
        counts, change, flat = np.diff(starts), {}, ids.tolist()
        for k, at, a, b in zip(bad.tolist(), misfit[first].tolist(), starts[bad].tolist(), starts[bad + 1].tolist()):
            change[k] = self._walk(pieces[k], flat[a:b], at - a + 1)
        whole = self.ids.get
        for k, i in enumerate(map(whole, pieces)):
            if i is not None and (counts[k] > 1 or k in change):
                change[k] = [i]
        if not change:
            return counts, ids
        keep = np.ones(len(pieces), bool)
        keep[list(change)] = False
        new_counts = counts.copy()
        new_counts[list(change)] = [len(x) for x in change.values()]
        out, at = np.empty(int(new_counts.sum()), np.int64), np.cumsum(new_counts) - new_counts
        out[spread(at[keep], counts[keep])] = ids[np.repeat(keep, counts)]
        out[spread(at[~keep], new_counts[~keep])] = np.fromiter(chain.from_iterable(change[k] for k in sorted(change)), np.int64)
        return new_counts, out

    def _new_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each run, the ids one after another) of runs between safe borders, not memoised."""
        parts, many = [], []
        for run in runs:
            if run.isalpha() or run[0] == " " and run[1:].isalpha():  # letters only: no need of the pattern
                parts.append(run)
                many.append(1)
            else:
                found = self.pieces.findall(run)
                parts += found
                many.append(len(found))
        counts, ids = self.encode_pieces([p if p.isascii() else p.encode().decode("latin-1") for p in parts])
        return np.add.reduceat(counts, np.cumsum([0, *many])[:-1]) if runs else counts, ids

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each run, the ids one after another). Two generations of a bounded memo keep frequent runs."""
        if self.new.many >= MEMO_RUNS:
            self.new, self.old = Runs(), self.new
        numbers = np.fromiter(map(self.new.number.get, runs, repeat(-1)), np.int64, len(runs))
        at = np.flatnonzero(numbers < 0)
        if not len(at):
            return self.new.take(numbers)
        absent = [runs[k] for k in at.tolist()]
        missed = list(dict.fromkeys(absent))
        before = np.fromiter(map(self.old.number.get, missed, repeat(-1)), np.int64, len(missed))
        again, fresh = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
        self.new.add([missed[k] for k in again.tolist()], *self.old.take(before[again]))
        names = [missed[k] for k in fresh.tolist()]
        sizes, ids = self._new_runs(names)
        self.new.add(names, sizes, ids)
        numbers[at] = np.fromiter(map(self.new.number.__getitem__, absent), np.int64, len(absent))
        taken = self.new.take(numbers)
        for long in [x for x in names if len(x) > MEMO_LENGTH]:
            del self.new.number[long]  # found by no later run; its ids go with the generation
        return taken

    def encode_all(self, texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, the ids one after another); null texts are empty."""
        counts, out = [], [np.empty(0, np.int32)]
        runs: list[str] = []
        owners: list[int] = []

        def flush() -> None:
            sizes, ids = self.encode_runs(runs)
            out.append(ids.astype(np.int32))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lengths = np.diff([*owners, len(runs)])
            stops = np.cumsum(lengths) + owners[0] if owners else lengths
            for k, (a, b) in enumerate(zip(owners, stops.tolist())):
                counts[len(counts) - len(owners) + k] += int(ends[b] - ends[a])
            runs.clear()
            owners.clear()

        for text in texts:
            counts.append(0)
            owners.append(len(runs))
            if text and len(text) < 8 * RUNS_AT_ONCE:
                runs += CHUNK.findall(text)
            elif text:
                found = CHUNK.finditer(text)
                while some := [m[0] for m in islice(found, RUNS_AT_ONCE)]:
                    runs += some
                    flush()
                    owners.append(0)
            if len(runs) >= RUNS_AT_ONCE:
                flush()
        flush()
        return np.array(counts, np.int64), np.concatenate(out)

    def encode(self, text: str) -> list[int]:
        return self.encode_all(iter([text]))[1].tolist()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of bytes of each row of `counts` ids, the bytes one after another)."""
        stops = np.cumsum(counts)
        ends, done, out = np.zeros(len(counts), np.int64), 0, []
        for k in range(0, len(ids), AT_ONCE):  # bounds the index arrays
            some = ids[k : k + AT_ONCE]
            sizes = self.lengths[some]
            out.append(self.data[spread(self.at[some], sizes)])
            a, b = np.searchsorted(stops, [k, k + len(some)], side="right")
            ends[a:b] = done + np.cumsum(sizes)[stops[a:b] - k - 1]
            done += int(sizes.sum())
        a = np.searchsorted(stops, 0, side="right")  # rows before the first id
        ends[a:] = np.maximum.accumulate(ends[a:])
        return np.diff(ends, prepend=0), np.concatenate([np.empty(0, np.uint8), *out])

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[1].tobytes()


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file (base64 and rank by line), loaded once in a process."""
    key = (path, pattern)
    if key not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(raw): int(rank) for raw, rank in (x.split() for x in lines if x.strip())}
        _LOADED[key] = Vocabulary(ranks, pattern)
    return _LOADED[key]


def _offsets(counts: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _id_lists(v: Vocabulary, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    counts, ids = v.encode_all(x.as_py() for x in texts)
    return pa.ListArray.from_buffers(pa.list_(pa.int32()), len(counts), [None, _offsets(counts)], children=[pa.array(ids, pa.int32())]), counts, ids


def _decoded(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    sizes, data = v.decode_all(ids, counts)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, _offsets(sizes), pa.py_buffer(data)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with `out`, an array of int: the ids of the whole text (null and empty texts: an empty array).

    One Arrow pass, no shuffle. Memory: a batch, the vocabulary and bounded memos; of a batch, only some runs are
    Python objects at a time, and a very long text goes through in portions. Texts of any length are encoded
    whole; repeated rows and extra columns are kept as they are; an `out` column that is there already is
    replaced; an empty table gives no rows. The rank file is installed with Python on every machine, like a library.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return _id_lists(vocabulary(path, pattern), texts)[0]

    return df.withColumn(out, ids_of(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`, the bytes that the ids stand for (null and empty ids: empty). Binary, as ids may cut a character.

    Repeated rows, extra columns and arrays of any length are kept as they are; an `out` column that is there
    already is replaced; an empty table gives no rows.
    """

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        return _decoded(vocabulary(path, pattern), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)

    return df.withColumn(out, bytes_of(F.col(ids)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", out: str = "decoded") -> DataFrame:
    """(*keep, ids, out): the ids of the whole text and the bytes that these ids stand for, in one Arrow pass.

    Two functions in a row would run the encoder twice, once for the ids and once below the decoder. Batches are
    worked in slices of SLICE_BYTES of text, so the memory of a worker hangs on the memos and one slice (or one
    text, if that is longer). Nulls, repeated rows and empty tables are as for encode and decode; columns that are
    not in `keep` go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for piece in _slices(batch, SLICE_BYTES):
                lists, counts, made = _id_lists(v, piece.column(0))
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], lists, _decoded(v, made, counts)], names=[*keep, ids, out])
            give_back()

    schema = StructType([*[df.schema[c] for c in keep], StructField(ids, ArrayType(IntegerType())), StructField(out, BinaryType())])
    return df.select(F.col(text), *keep).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose first column has about `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lot = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]]).tolist() if len(lot) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)
