"""Line dedup by a deletion-neighbourhood join.

Two lines are alike when their word sequences are equal, or when both have `min_words` words or more and as many edits of a
word (replaced, inserted or left out) as `allowed` turn one into the other: one for each words_per_edit words of the shorter
line, and one at least, without an upper end. A line goes when an alike line stands earlier, by (doc_id, line
number); the earliest of its kind stays. Blank lines stay.

1. Equal lines are one: a combining aggregation by the line's hash keeps the earliest place, so a line that millions of
   documents share is one row.
2. One edit leaves the first or the last half untouched. Each line to which that applies (the shorter of two lines is below
   2 * words_per_edit words) gives its halves as keys (for its own length and the next smaller, which is what a pair has in
   common); lines that share a half with another go on.
3. Only these give their deletion neighbourhood: all variants with one word left out, as hashed keys. Variants with the
   same word place left out are equal exactly if a replacement joins the lines, so the earliest of a key stands for all its
   lines and no pairs are made; a line that equals another's variant is an insertion, and joins it by that key alone.
4. The pair (line, earliest alike) is verified by the edit distance of the words themselves.
5. Lines long enough for k > 1 edits: an edit spoils no two runs of words that have no word in common, so k edits leave one of
   any k + 1 such runs. Each line gives its first runs, in one order for all lines, up to the one with which k + 1 of them lie
   apart; two alike lines share one of these. The order is rarest first, by a sketch of fixed size, and a run is a third of
   words_per_edit, so few lines share one. Of those that do, pairs go on whose lengths allow it and whose maps of parities (on
   which of MAP_BITS bits an odd number of words falls) differ in 2 k bits at most, as an edit changes two. A line is paired
   with the earliest of the run and length; only lines for which that leaves nothing, or turns out not to be alike, are paired
   with all earlier ones.

Defined cases: null or blank texts have no lines and come back unchanged; a row without doc_id takes no part and comes back
unchanged; rows of equal doc_id count as one document, so repeated rows are treated alike; the empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import discard, materialise, passing, tidy
from .shingles import mixed, slices, word_bounds, word_hashes
from .sketch import class_of, commonness, sketch
from .textfilter import bits_of, texts_near

#: The default of min_words: an edit changes more of a shorter line than near copies differ; such lines are alike when equal.
MIN_WORDS = 8
#: One edit is allowed for each so many words of the shorter line; 2 * RUN at least, as else k edits could spoil all its runs.
WORDS_PER_EDIT = 12
#: The least words of a run.
RUN = 2
MAP_BITS = 128
#: Runs are known by so many bits of their hash, and sorted in one number with a class (8 bits) and the line within its slice.
KEY_BITS = 38
#: Lines of more edits give as many runs as suffice wherever these lie, k * run + 1.
APART = 64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_UNSTEP = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_PREFIX, _SUFFIX, _SAME_PLACE, _ONE_LESS = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))


class Sequences:
    """Hashes of any runs of words of one slice of texts, by prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = words
        self.powers = np.full(n + 1, _STEP, np.uint64)
        self.back = np.full(n + 1, _UNSTEP, np.uint64)
        self.powers[0] = self.back[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.powers[:-1], out=self.total[1:])

    def form(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words start to end: sum of word_i * STEP^(i - start)."""
        return (self.total[end] - self.total[start]) * self.back[start]

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.form(start, end) + (end - start).astype(np.uint64))

    def without(self, start: int, end: int, at: np.ndarray) -> np.ndarray:
        """Hashes of words start to end with the word at `at` left out."""
        s, e = np.full(len(at), start), np.full(len(at), end)
        form = self.form(s, at) + self.form(at + 1, e) * self.powers[at - start]
        return mixed(form + np.uint64(end - start - 1))


def line_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """As slices, with the number of the first line; a text longer than a slice comes in parts that end with lines."""
    for first, last, b, offsets in slices(texts):
        if last - first > 1 or len(b) <= 2 * shingles.SLICE_BYTES:
            yield first, last, b, offsets, 0
            continue
        feeds = np.flatnonzero(b == 10) + 1
        start = passed = 0
        while start < len(b):
            k = int(np.searchsorted(feeds, start + shingles.SLICE_BYTES))
            end = int(feeds[k]) if k < len(feeds) else len(b)
            yield first, last, b[start:end], np.array([0, end - start]), passed
            passed, start = k + 1, end


def line_words(b: np.ndarray, offsets: np.ndarray) -> tuple[Sequences, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice: its word hashes, and for each line that has words its row, line number, first word and word after."""
    starts, ends = word_bounds(b, offsets)
    words = Sequences(word_hashes(b, starts, ends))
    feeds = np.flatnonzero(b == 10)
    begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1])) if len(b) else feeds
    begins = begins[begins < len(b)]
    row = np.searchsorted(offsets, begins, side="right") - 1
    number = np.searchsorted(feeds, begins) - np.searchsorted(feeds, offsets[row])
    first = np.searchsorted(starts, begins)
    after = np.concatenate([first[1:], [len(starts)]]) if len(first) else first
    some = after > first
    return words, row[some], number[some], first[some], after[some]


def run_words(words_per_edit: int) -> int:
    """Words of a run: any line of k edits has 2 k runs that lie apart, or more."""
    return max(RUN, words_per_edit // 3)


def run_hashes(seq: Sequences, s: np.ndarray, e: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of `width` words of lines of that many or more, and which line each is of."""
    times = e - s - width + 1
    owner = np.repeat(np.arange(len(s)), times)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times) + s[owner]
    return seq.hashed(start, start + width), owner


def all_runs(texts: pa.Array, least: int, width: int) -> Iterator[np.ndarray]:
    for _, _, b, offsets, _ in line_slices(texts):
        seq, _, _, s, e = line_words(b, offsets)
        yield run_hashes(seq, s[e - s >= least], e[e - s >= least], width)[0]


def apart(at: np.ndarray, times: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Of each line: how many of its runs it takes until `wanted` of them have no word in common (else all). `at` holds the
    places of the runs, line by line (`times` for each) and in the order in which they are taken."""
    first, need = np.cumsum(times) - times, times.copy()
    blocked = np.zeros(len(at) + width * (len(times) + 2), np.bool_)
    near = np.arange(1 - width, width)
    at = at + np.repeat(np.arange(1, len(times) + 1) * width, times)  # no run is near one of another line
    got, open_ = np.zeros(len(times), np.int64), np.flatnonzero(times > 0)
    taken = 0
    while len(open_):
        here = at[first[open_] + taken]
        free = ~blocked[here]
        blocked[here[free][:, None] + near] = True
        got[open_] += free
        taken += 1
        done = got[open_] >= wanted[open_]
        need[open_[done]] = taken
        open_ = open_[~done & (times[open_] > taken)]
    return need


def first_runs(seq: Sequences, s: np.ndarray, e: np.ndarray, classes: np.ndarray, words_per_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lines of two edits or more: their first distinct runs by commonness and hash, line by line, up to the one with which
    more runs lie apart than there are edits, and how many each has."""
    width = run_words(words_per_edit)
    hashes, owner = run_hashes(seq, s, e, width)
    key = hashes & np.uint64((1 << KEY_BITS) - 1)
    whole = (owner.astype(np.uint64) << np.uint64(KEY_BITS + 8)) | (class_of(hashes, classes).astype(np.uint64) << np.uint64(KEY_BITS)) | key
    order = np.argsort(whole)
    whole, key = whole[order], key[order]
    new = np.r_[True, whole[1:] != whole[:-1]] if len(key) else np.zeros(0, bool)
    times, k = e - s - width + 1, (e - s) // words_per_edit
    begin = np.cumsum(times) - times
    few = k <= APART
    need = np.zeros(len(s), np.int64)
    need[few] = apart(order[few[owner]] - np.repeat(begin[few] - (np.cumsum(times[few]) - times[few]), times[few]), times[few], k[few] + 1, width)
    place = np.arange(len(owner)) - begin[owner]
    count = np.cumsum(new)
    nth = count - (count[begin] - 1)[owner] if len(owner) else count  # of the distinct runs of its line, from 1
    stay = new & np.where(few[owner], place < need[owner], nth <= (k * width + 1)[owner])
    return key[stay], np.bincount(owner[stay], minlength=len(s))


def parities(seq: Sequences, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of each line MAP_BITS bits, as rows of longs: on which an odd number of its words falls."""
    times = e - s
    owner = np.repeat(np.arange(len(s)), times)
    word = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times) + s[owner]
    bit = (seq.words[word] & np.uint64(MAP_BITS - 1)).astype(np.int64)
    odd = np.bincount(owner * MAP_BITS + bit, minlength=len(s) * MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(s), MAP_BITS // 64)


def lines(docs: DataFrame, classes: np.ndarray, words_per_edit: int = WORDS_PER_EDIT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line_no, words and line (hash) of every line that has words; the half keys p1, p2, s1, s2 of those that may be
    the longer of two with one edit; and runs and the parity map m1, m2 of those that may have two edits or more."""
    schema = "doc_id long, line_no int, words int, line long, p1 long, p2 long, s1 long, s2 long, m1 long, m2 long, runs array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, b, offsets, passed in line_slices(batch.column(1)):
                seq, row, number, s, e = line_words(b, offsets)
                number += passed
                n = e - s
                if not len(n):
                    continue
                long = (n >= min_words) & (n <= 2 * words_per_edit)
                keys = []
                for size, tag, head in (((n // 2), _PREFIX, True), (((n - 1) // 2), _PREFIX, True), (((n + 1) // 2), _SUFFIX, False), ((n // 2), _SUFFIX, False)):
                    part = seq.hashed(s, s + size) if head else seq.hashed(e - size, e)
                    keys.append(mixed(part + tag).view(np.int64))
                even = n % 2 == 0
                alone = [~long, ~long | ~even, ~long, ~long | even]  # the two sizes of a half are one here
                cols = [pa.array(ids[at + row]), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seq.hashed(s, e).view(np.int64))]
                cols += [pa.array(k, pa.int64(), mask=m) for k, m in zip(keys, alone, strict=True)]
                more = np.flatnonzero(n >= max(min_words, 2 * words_per_edit))
                maps, own = np.zeros((len(n), MAP_BITS // 64), np.int64), np.zeros(len(n), np.int64)
                flat, own[more] = first_runs(seq, s[more], e[more], shared.value, words_per_edit)
                maps[more] = parities(seq, s[more], e[more])
                cols += [pa.array(m, pa.int64(), mask=own == 0) for m in maps.T.copy()]
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(tidy(run), schema)


def neighbourhoods(wanted: DataFrame) -> DataFrame:
    """kind (0 replaced, 1 one word less, 2 whole), key, line, doc_id, line_no, words of the lines wanted: doc_id, text, and
    asked, an array of line_no, line, front and end (which half another line shares)."""
    out = "kind byte, key long, line long, doc_id long, line_no int, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, asked = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for at, last, b, offsets, passed in line_slices(texts):
                seq, rows, number, s, e = line_words(b, offsets)
                place = {(r, k): i for i, (r, k) in enumerate(zip(rows.tolist(), number.tolist(), strict=True))}
                kinds, keys, made = [], [], []
                for row in range(at, last):
                    text = None
                    for line in asked[row]:
                        i = place.get((row - at, line["line_no"] - passed))
                        start, end = (int(s[i]), int(e[i])) if i is not None else (0, 0)
                        if i is None or seq.hashed(s[i : i + 1], e[i : i + 1]).view(np.int64)[0] != line["line"]:
                            continue  # another row of the same doc_id
                        n = end - start
                        low = 0 if line["end"] else max(0, (n - 1) // 2 - 1)
                        high = n if line["front"] else min(n, (n + 1) // 2 + 1)
                        places = np.arange(start + low, start + high)
                        less = seq.without(start, end, places)
                        same = mixed(less + _SAME_PLACE + (places - start).astype(np.uint64) * _STEP)
                        fewer = np.unique(mixed(less + _ONE_LESS))
                        whole = mixed(seq.hashed(s[i : i + 1], e[i : i + 1]) + _ONE_LESS)
                        text = b[offsets[row - at] : offsets[row - at + 1]].tobytes().decode().split("\n") if text is None else text
                        kinds.append(np.repeat(np.array([0, 1, 2], np.int8), [len(same), len(fewer), 1]))
                        keys.append(np.concatenate([same, fewer, whole]))
                        made.append((line["line"], ids[row], line["line_no"], text[line["line_no"] - passed], len(keys[-1])))
                if not made:
                    continue
                times = [m[4] for m in made]
                spread = lambda k, t: pa.array([m[k] for m in made], t).take(pa.array(np.repeat(np.arange(len(made)), times)))  # noqa: E731, B023
                content = [None] * sum(times)
                end = -1
                for m in made:  # the words themselves go with the whole line's row only
                    end += m[4]
                    content[end] = m[3]
                cols = [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), spread(0, pa.int64()), spread(1, pa.int64()), spread(2, pa.int32()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["kind", "key", "line", "doc_id", "line_no", "content"])

    return wanted.mapInArrow(tidy(run), out)


def allowed(words: int, words_per_edit: int = WORDS_PER_EDIT, min_words: int = MIN_WORDS) -> int:
    """Edits that make two lines alike, of which the shorter has so many words."""
    return max(1, words // words_per_edit) if words >= min_words else 0


def edits(a: list, b: list, limit: int = 1) -> int:
    """Word edits from a to b up to `limit`, or limit + 1 for more. Furthest places on the diagonals, edit by edit."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    before: dict[int, int] = {}
    for spent in range(limit + 1):
        now = {}
        for d in range(-spent, spent + 1):
            if abs(m - n - d) > limit - spent:
                continue  # the rest can't be made up
            i = max(before.get(d, -2) + 1, before.get(d - 1, -2), before.get(d + 1, -2) + 1) if spent else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            if i == n and i + d == m:
                return spent
            now[d] = i
        before = now
    return limit + 1


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, one after the other, as numbers that are equal for equal words, and where each text's begin
    (and the end)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, ends = word_bounds(b, offsets - offsets[0])
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b[inside].tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, offsets - offsets[0])


def bag_distance(words: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of pairs of runs of `words` (n from a, and m from b): words of the one that the other lacks, repeats counted, or the other
    way round, whichever are more. As many edits at least turn one into the other."""
    size = np.concatenate([n, m])
    pair = np.repeat(np.tile(np.arange(len(n)), 2), size)
    at = np.arange(len(pair)) + np.repeat(np.concatenate([a, b]) - (np.cumsum(size) - size), size)
    key = pair * (int(words.max(initial=0)) + 1) + words[at]
    order = np.argsort(key)
    new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
    sign = np.where(np.arange(len(pair)) < n.sum(), 1, -1)[order]
    spare = np.add.reduceat(sign, new) if len(new) else sign
    of = pair[order][new]
    more = np.bincount(of, np.maximum(spare, 0), len(n)), np.bincount(of, np.maximum(-spare, 0), len(n))
    return np.maximum(*more).astype(np.int64)


def alike(left: pa.Array, right: pa.Array, words_per_edit: int, min_words: int) -> np.ndarray:
    """Whether the lines left[i] and right[i] are alike, for each i."""
    words, at = word_numbers(pa.concat_arrays([left.cast(pa.large_string()), right.cast(pa.large_string())]))
    half, size = len(left), np.diff(at)
    n, m, a, b = size[:half], size[half:], at[:half], at[half:-1]
    limits = np.array([allowed(x, words_per_edit, min_words) for x in np.minimum(n, m).tolist()], np.int64)
    out = bag_distance(words, a, n, b, m) <= limits
    for i in np.flatnonzero(out).tolist():
        limit = int(limits[i])
        out[i] = edits(words[a[i] : a[i] + n[i]].tolist(), words[b[i] : b[i] + m[i]].tolist(), limit) <= limit
    return out


def members(kept: DataFrame) -> DataFrame:
    """key, words and own (doc_id, line_no, line, m1, m2): the distinct lines under each run that two or more have."""
    keyed = kept.where("size(runs) > 0")
    shared = keyed.select(F.explode("runs").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = materialise(shared, "lines-runs-shared")
    among = kept.sparkSession.sparkContext.broadcast(bits_of(shared, F.col("key")))  # a filter of fixed size; the join below is exact
    names = ["line", "words", "m1", "m2", "doc_id", "line_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            key = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            bit = key.view(np.uint64) & np.uint64(len(among.value) * 64 - 1)
            stay = ((among.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            of = batch.select(names).take(pa.array(owner[stay]))
            yield pa.RecordBatch.from_arrays([pa.array(key[stay]), *of.columns], names=["key", *names])

    near = keyed.select(*names, "runs").mapInArrow(tidy(run), "key long, line long, words int, m1 long, m2 long, doc_id long, line_no int")
    near = near.join(shared, "key", "left_semi")
    out = materialise(near.select("key", "words", F.struct("doc_id", "line_no", "line", "m1", "m2").alias("own")), "lines-runs")
    discard(shared)
    return out


def contents(wanted: DataFrame) -> DataFrame:
    """line, content of doc_id, text, and asked, an array of line_no and line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = batch.column(1), batch.column(2).to_pylist()
            for at, last, b, offsets, passed in line_slices(texts):
                seq, rows, number, s, e = line_words(b, offsets)
                hashes = dict(zip(zip(rows.tolist(), number.tolist(), strict=True), seq.hashed(s, e).view(np.int64).tolist(), strict=True))
                lines_, found = [], []
                for row in range(at, last):
                    text = None
                    for line in asked[row]:
                        if hashes.get((row - at, line["line_no"] - passed)) == line["line"]:  # else another part, or another row of the same doc_id
                            text = b[offsets[row - at] : offsets[row - at + 1]].tobytes().decode().split("\n") if text is None else text
                            lines_.append(line["line"])
                            found.append(text[line["line_no"] - passed])
                yield pa.RecordBatch.from_arrays([pa.array(lines_, pa.int64()), pa.array(found, pa.string())], names=["line", "content"])

    return wanted.mapInArrow(tidy(run), "line long, content string")


def verified(pairs: DataFrame, words_per_edit: int, min_words: int) -> DataFrame:
    """line: those of line, content, earlier (two texts) that are alike."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = alike(batch.column(1), batch.column(2), words_per_edit, min_words)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["line"]).filter(pa.array(same, pa.bool_()))

    return pairs.select("line", "content", "earlier").mapInArrow(tidy(verify), "line long")


def doomed_by_more(docs: DataFrame, runs: DataFrame, words_per_edit: int, min_words: int) -> DataFrame:
    """line: those of the members that have an earlier line within the edits allowed, where these are two or more."""
    edits_ = F.floor(F.least("words", "other_words") / words_per_edit)
    fits = F.abs(F.col("words") - F.col("other_words")) <= edits_
    differ = F.bit_count(F.col("own.m1").bitwiseXOR(F.col("other.m1"))) + F.bit_count(F.col("own.m2").bitwiseXOR(F.col("other.m2")))
    may = fits & (F.col("other") < F.col("own")) & (differ <= 2 * edits_)
    ends = lambda pairs: pairs.where(may).select(*[F.struct(*[F.col(f"{s}.{c}") for c in ("doc_id", "line_no", "line")]).alias(s) for s in ("own", "other")]).distinct()

    def with_all(left: DataFrame) -> DataFrame:
        return ends(left.join(runs.select("key", F.col("words").alias("other_words"), F.col("own").alias("other")), "key"))

    def found_alike(pairs: DataFrame, label: str) -> DataFrame:
        asked = pairs.select("own").union(pairs.select("other")).distinct().groupBy("own.doc_id").agg(F.collect_list(F.struct("own.line_no", "own.line")).alias("asked"))
        asked = materialise(asked, f"lines-pairs-asked-{label}")
        content = materialise(contents(texts_near(docs, asked.select("doc_id")).join(asked, "doc_id").select("doc_id", "text", "asked")).dropDuplicates(["line"]), f"lines-pairs-texts-{label}")
        both = pairs.select("own.line", F.col("other.line").alias("other")).join(content, "line").join(content.select(F.col("line").alias("other"), F.col("content").alias("earlier")), "other")
        out = materialise(verified(both, words_per_edit, min_words).distinct(), f"lines-pairs-alike-{label}")
        discard(asked, content)
        return out

    left = runs.withColumn("line", F.col("own.line"))
    earliest = runs.groupBy("key", "words").agg(F.min("own").alias("other")).withColumn("other_words", F.col("words"))
    first = materialise(ends(left.join(earliest, ["key", "words"])), "lines-pairs-first")
    rest = materialise(with_all(left.join(first.select("own.line"), "line", "left_anti")), "lines-pairs-rest")
    found = found_alike(first.union(rest), "most")
    unlike = materialise(first.select("own.line").distinct().join(found, "line", "left_anti"), "lines-pairs-unlike")
    if unlike.isEmpty():
        return found
    again = materialise(with_all(left.join(unlike, "line", "left_semi")).join(first, ["own", "other"], "left_anti"), "lines-pairs-again")
    return found.union(found_alike(again, "again"))


def doomed(kept: DataFrame, docs: DataFrame, words_per_edit: int, min_words: int) -> DataFrame:
    """line: those of the distinct lines `kept` that have an earlier line one edit away, where one is allowed."""
    halves = kept.where(F.col("words").between(min_words, 2 * words_per_edit)).select("line", "doc_id", "line_no", F.explode(F.array(*[F.struct(F.col(k).alias("key"), F.lit(k[0] == "p").alias("front")) for k in ("p1", "p2", "s1", "s2")])).alias("h"))
    halves = halves.select("line", "doc_id", "line_no", "h.key", "h.front").where("key IS NOT NULL")
    shared = halves.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("key")
    # `front`: it shares a front half, so the edit may be in the rest; `end`: the other way round
    asked = halves.join(shared, "key").groupBy("line", "doc_id", "line_no").agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("end"))
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line", "front", "end")).alias("asked"))
    asked = materialise(asked, "lines-asked")
    texts = texts_near(docs, asked.select("doc_id"))
    near = materialise(neighbourhoods(texts.join(asked, "doc_id").select("doc_id", "text", "asked")), "lines-near")
    own = F.struct("doc_id", "line_no", "line")
    places = near.where("kind = 0").select("key", own.alias("own"))
    earliest = places.groupBy("key").agg(F.min("own").alias("other"), F.max("own").alias("last")).where("other <> last").drop("last")
    replaced = places.join(earliest, "key").select("own", "other")
    less = near.where("kind = 1").select("key", own.alias("own")).join(near.where("kind = 2").select("key", own.alias("other")), "key").select("own", "other")
    inserted = less.union(less.select(F.col("other"), F.col("own")))
    pairs = replaced.union(inserted).where("other < own").groupBy(F.col("own.line").alias("line")).agg(F.min("other").alias("other"))
    content = near.where("kind = 2").select("line", "content")  # not made distinct, so that the joins may be split at a hot line
    pairs = pairs.select("line", F.col("other.line").alias("other")).join(content, "line").join(content.select(F.col("line").alias("other"), F.col("content").alias("earlier")), "other")

    return verified(pairs, words_per_edit, min_words)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines left in text_col, and n_lines and n_kept (lines that have words, before and after)."""
    if words_per_edit < 2 * RUN:
        raise ValueError(f"words_per_edit must be {2 * RUN} or more")
    if min_words < 2:
        raise ValueError("min_words must be 2 or more: a line of one word has no half")
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    classes, _ = commonness(sketch(slim, lambda texts: all_runs(texts, 2 * words_per_edit, run_words(words_per_edit))))
    with passing() as here:  # what is written goes as soon as nothing reads it any more
        found = lines(slim, classes, words_per_edit, min_words)
        found = found.groupBy("line").agg(F.min(F.struct(*[c for c in found.columns if c != "line"])).alias("x")).select("line", "x.*")
        found = materialise(found, "lines")  # the earliest of each, with its runs
        with passing() as first:
            gone = first.keep(materialise(doomed(found, slim, words_per_edit, min_words).distinct(), "lines-gone"))
        runs = members(found)
        places = here.keep(materialise(found.select("line", "doc_id", "line_no"), "lines-places"))
        discard(found)
        gone = here.keep(materialise(gone.union(doomed_by_more(slim, runs, words_per_edit, min_words)), "lines-gone-all"))
    kept = places.join(gone, "line", "left_anti")
    kept = kept.groupBy("doc_id").agg(F.collect_list("line_no").alias("line_dedup_kept")).withColumnRenamed("doc_id", "line_dedup_id")
    joined = docs.join(kept, docs[id_col].cast("long") == kept["line_dedup_id"], "left").drop("line_dedup_id")
    out = T.StructType([*[f for f in docs.schema.fields if f.name not in ("n_lines", "n_kept")], T.StructField("n_lines", T.IntegerType()), T.StructField("n_kept", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, stay, ids = (batch.column(names.index(c)).to_pylist() for c in (text_col, "line_dedup_kept", id_col))
            before, after = [], []
            for k, text in enumerate(texts):
                parts = (text or "").split("\n")
                worded = [bool(p.strip(" \t\n\x0b\x0c\r")) for p in parts]
                some = set(stay[k] or ()) if ids[k] is not None else set(range(len(parts)))
                left = [p for i, p in enumerate(parts) if not worded[i] or i in some]
                before.append(sum(worded))
                after.append(sum(w and i in some for i, w in enumerate(worded)))
                if text is not None and after[-1] < before[-1]:
                    texts[k] = "\n".join(left)
            cols = dict(zip(names, batch.columns, strict=True)) | {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(before, pa.int32()), "n_kept": pa.array(after, pa.int32())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in out.fields], names=[f.name for f in out.fields])

    return joined.mapInArrow(tidy(run), out)
