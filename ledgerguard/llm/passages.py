"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: of the hashes of all runs of ``K`` words, the least of every ``WINDOW`` neighbours (minimisers).
   Any run of K + WINDOW - 1 words that two documents share gives them a common seed (where words repeat with
   a short period, one in twice that).
2. Each seed has one owner, the least doc_id that holds it (its first place there). Every other occurrence
   is matched with the owner's only, so a passage of n documents gives n - 1 rows for each seed, not n^2.
   So has each run of ``RUN`` successive seeds at the same distances, and its match counts for all its seeds.
   Where earlier documents hold the parts of a passage one by one, the runs across the parts' ends still belong
   to the first document that holds them together. (A passage of one repeated line has few distinct seeds; its
   runs give it the MIN_SEEDS places in the owner.) A seed that stands again within ``MIN_WORDS`` words is also
   matched by how often it stood there before, as changed words in such a passage break the runs.
3. Matches of a document with one owner are chained: places must ascend in both, a match is worth K, and the
   words skipped on either side cost ``GAP`` each. A Fenwick tree over the owner's places holds the best
   chain so far, so a chain over n matches takes n log n steps. Chains start anew where going on would not pay.
4. Chains are aligned on the words themselves: between matches by longest common subsequence, at both ends
   by extension until mismatches outweigh. A passage counts if it has ``MIN_WORDS`` words in both documents
   and ``MIN_IDENTITY`` of the longer side is matched. Of a chain that falls below that as a whole (it may join
   two passages across unlike words) the longest stretches that reach it are passages of their own.

The first document that holds a passage keeps it; later ones are reported with (and, in the pipeline, cut at)
their spans. Words are compared in lower case.

Defined results: null, empty and short texts (fewer than MIN_WORDS words) have no passages; rows with a null
id take no part; rows that share an id are one document to each other; spans count words, ends exclusive; an
empty table gives no rows. Long documents are worked on whole; a task holds the seeds of one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm import wordhash
from ledgerguard.llm.common import map_arrow, materialize

K = 5
WINDOW = 10
GAP = 0.2
MIN_SEEDS = 3
RUN = 4  # successive seeds that are matched as one besides
STEP_BITS = 10  # of the distance between two seeds, in a run's key
MIN_WORDS = 50
MIN_IDENTITY = 0.8
MARGIN = 48  # words read on both sides of a chain, for its extension
GRID = 64  # spans to read are rounded to multiples, so that few different ones are asked of a document
MISMATCH, DROP = 2, 12  # extension: a mismatch costs so much, and it ends so far below its best


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the first of equal ones) of every ``window`` neighbours."""
    if len(hashes) <= window:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    # Where words repeat with a short period the same hash is least again and again. Of such a run one place in
    # each stretch of ``window`` words stays, so that a repeated word pair does not make a seed for every word.
    run = np.concatenate([[True], (hashes[at[1:]] != hashes[at[:-1]]) | (at[1:] - at[:-1] >= window)])
    stretch = (at - at[run][np.cumsum(run) - 1]) // window
    return at[run | np.concatenate([[False], stretch[1:] != stretch[:-1]])]


def seed_runs(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, packed distances) of each run of RUN successive seeds (hashes ``own``, places ``at``)."""
    n = len(at) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = np.diff(at)
    steps = np.zeros(n, np.int64)
    for i in range(RUN - 1):
        steps = steps << STEP_BITS | apart[i:n + i]
    near = (np.lib.stride_tricks.sliding_window_view(apart, RUN - 1) < 1 << STEP_BITS).all(axis=1)
    h = wordhash.mix(wordhash.shingles(own, RUN) + steps.astype(np.uint64) * wordhash._MULT[RUN])
    return h[near], at[:n][near], steps[near]


def repeats(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of seeds that stand again within MIN_WORDS words, told apart by how many times they stood
    there before. A seed's count starts anew at the first place beyond those words."""
    order = np.lexsort((at, own))
    same = np.flatnonzero(own[order][1:] == own[order][:-1]) + 1
    seeds, places = [], []
    last = -1
    for i in same.tolist():
        if i - 1 != last:
            start, n = int(at[order[i - 1]]), 0
        last = i
        place = int(at[order[i]])
        if place - start >= MIN_WORDS:
            start, n = place, 0
            continue
        n += 1
        seeds.append(order[i])
        places.append(n)
    which = np.array(seeds, np.int64)
    return wordhash.mix(own[which] + np.array(places, np.uint64) * wordhash._MULT[RUN + 1]), at[which]


def _seeder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, rows, data, bounds in wordhash.text_runs(batch.column(1)):
            words, _, _, first = wordhash.words(data, bounds, lower=True)
            runs = wordhash.shingles(words, K)
            h, doc, pos, steps, lead = [], [], [], [], []
            for i in range(rows):
                a, b = first[i], first[i + 1]
                if b - a < MIN_WORDS:
                    continue
                own = runs[a:b - K + 1]
                at = minimisers(own, WINDOW)
                own = own[at]
                run, run_at, run_steps = seed_runs(own, at)
                again, again_at = repeats(own, at)
                own, at = np.concatenate([own, again, run]), np.concatenate([at, again_at, run_at])
                is_first = np.zeros(len(at), bool)
                is_first[np.unique(own, return_index=True)[1]] = True
                h.append(own)
                pos.append(at)
                steps.append(np.concatenate([np.zeros(len(at) - len(run), np.int64), run_steps]))
                lead.append(is_first)
                doc.append(np.full(len(at), doc_ids[row + i], np.int64))
            if h:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32)),
                     pa.array(np.concatenate(steps).astype(np.int32)), pa.array(np.concatenate(lead))], ["h", "doc", "pos", "steps", "lead"])


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Best chains of the matches (x, y), each as ascending indices, a match in one chain at most.

    f(i) = K + max(0, max over j before i in both of f(j) - GAP * (words skipped on both sides)); with the
    cost linear in both places, the maximum over earlier places is a prefix maximum in the Fenwick tree."""
    order = np.lexsort((-y, x))
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max()) + 1
    best, who = [-1e18] * size, [-1] * size
    score, back = [0.0] * len(x), [-1] * len(x)
    xs, ys, ranks = x.tolist(), y.tolist(), rank.tolist()
    for i in order.tolist():
        top, j, r = -1e18, -1, ranks[i] - 1
        while r > 0:
            if best[r] > top:
                top, j = best[r], who[r]
            r &= r - 1
        reach = top - GAP * (xs[i] + ys[i] - 2 * K)
        score[i], back[i] = (K + reach, j) if j >= 0 and reach > 0 and xs[j] < xs[i] else (float(K), -1)
        value, r = score[i] + GAP * (xs[i] + ys[i]), ranks[i]
        while r < size:
            if value > best[r]:
                best[r], who[r] = value, i
            r += r & -r
    used = [False] * len(x)
    out = []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        run = []
        while i >= 0 and not used[i]:
            used[i] = True
            run.append(i)
            i = back[i]
        if len(run) >= MIN_SEEDS:
            out.append(np.array(run[::-1]))
    return out


_CHAIN = "doc long, owner long, anchors binary, a int, b int, oa int, ob int"


def every_seed(cols: list[np.ndarray]) -> list[np.ndarray]:
    """(doc, owner, pos, opos) of all seeds of the matches, sorted by document and owner."""
    doc, owner, pos, opos, steps = cols
    is_run = np.flatnonzero(steps)
    if not len(is_run):
        return [doc, owner, pos, opos]
    at, parts, far = np.arange(len(doc)), [], np.zeros(len(is_run), np.int32)
    for i in range(RUN - 2, -1, -1):
        far = far + (steps[is_run] >> i * STEP_BITS & (1 << STEP_BITS) - 1)
        parts.append(far)
    at = np.concatenate([at, *[is_run] * len(parts)])
    far = np.concatenate([np.zeros(len(doc), np.int32), *parts])
    order = np.lexsort((owner[at], doc[at]))
    at, far = at[order], far[order]
    return [doc[at], owner[at], pos[at] + far, opos[at] + far]


def _chainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by (doc, owner) -> chains long enough to be extended to a passage."""
    held: list[np.ndarray] | None = None

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, owner, pos, opos = every_seed(cols)
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]])
        rows = []
        for s, e in zip(starts[ends - starts >= MIN_SEEDS].tolist(), ends[ends - starts >= MIN_SEEDS].tolist()):
            pairs = np.unique(np.stack([pos[s:e], opos[s:e]], axis=1), axis=0)
            x, y = pairs[:, 0], pairs[:, 1]
            for run in chains(x, y):
                cx, cy = x[run], y[run]
                if min(cx[-1] - cx[0], cy[-1] - cy[0]) + K < MIN_WORDS - 2 * (K + WINDOW):
                    continue
                down = lambda v: max(0, int(v) - MARGIN) // GRID * GRID
                up = lambda v: -(-(int(v) + K + MARGIN) // GRID) * GRID
                rows.append((int(doc[s]), int(owner[s]), np.stack([cx, cy]).astype("<i4").tobytes(), down(cx[0]), up(cx[-1]), down(cy[0]), up(cy[-1])))
        cols_ = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds)], ["doc", "owner", "anchors", "a", "b", "oa", "ob"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        if not len(cols[0]):
            continue
        # the last document may go on in the next batch
        split = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if (cols[0] != cols[0][-1]).any() else 0
        if split:
            yield from done([c[:split] for c in cols])
        held = [c[split:] for c in cols]
    if held is not None and len(held[0]):
        yield from done(held)


def _span_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans) -> a row (doc, a, b, words) for each span; words as 32-bit hashes."""
    for batch in batches:
        docs, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for row, rows, data, bounds in wordhash.text_runs(batch.column(1)):
            words, _, _, first = wordhash.words(data, bounds, lower=True)
            small = (words >> np.uint64(32)).astype("<u4")
            out = [(docs[row + i], s["a"], s["b"], small[first[i]:first[i + 1]][s["a"]:s["b"]].tobytes()) for i in range(rows) for s in spans[row + i]]
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "a", "b", "words"])


def _extension(same: np.ndarray) -> tuple[int, int]:
    """(words, matches) by which a passage grows along equal or unequal word pairs."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -MISMATCH))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[:fallen[0]] if len(fallen) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    end = int(score.argmax()) + 1
    return end, int(same[:end].sum())


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits of one integer."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    row, mask = 0, (1 << len(a)) - 1
    for w in b.tolist():
        x = row | places.get(w, 0)
        y = (row << 1) | 1
        row = x & (x ^ (x - y)) & mask
    return bin(row).count("1")


def _windows(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint runs [i, j] of anchors with MIN_IDENTITY, those of most anchors first (the first of equal ones).
    ``total`` is the running sum of words matched since the anchor before."""
    free = np.zeros(len(x) + 1, np.int64)  # running count of anchors in earlier runs
    out = []
    for n in range(len(x), MIN_SEEDS - 1, -1):
        matched = total[n - 1:] - total[:len(x) - n + 1] + K
        dx, dy = x[n - 1:] - x[:len(x) - n + 1] + K, y[n - 1:] - y[:len(x) - n + 1] + K
        fits = (matched >= MIN_IDENTITY * np.maximum(dx, dy)) & (np.minimum(dx, dy) >= MIN_WORDS - 2 * (K + WINDOW)) & (free[n:] == free[:len(x) - n + 1])
        last = -1
        for i in np.flatnonzero(fits).tolist():
            if i > last:
                last = i + n - 1
                out.append((i, last))
                free[i + 1:] += np.minimum(np.arange(1, len(x) - i + 1), n)
    return out


def align(anchors: np.ndarray, doc: np.ndarray, owner: np.ndarray, a: int, oa: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, owner start, owner end, matched words) of a chain's passages; ``doc`` and ``owner`` hold the
    words from place ``a`` and ``oa`` on. A chain that spans too many unlike words as a whole is split."""
    x, y, matched = [int(anchors[0][0]) - a], [int(anchors[1][0]) - oa], [0]
    for i, j in zip((anchors[0][1:] - a).tolist(), (anchors[1][1:] - oa).tolist()):
        at, oat = x[-1] + K, y[-1] + K
        step = max(0, at - i, oat - j)  # words of the k-mer that are counted already
        if step >= K:
            continue
        matched.append(common_words(doc[at:i + step], owner[oat:j + step]) + K - step)
        x.append(i)
        y.append(j)
    total = np.cumsum(matched)

    def passage(i: int, j: int, grow: bool) -> tuple[int, int, int, int, int]:
        s, o, at, oat = x[i], y[i], x[j] + K, y[j] + K
        words = int(total[j] - total[i]) + K
        if grow:
            room = min(len(doc) - at, len(owner) - oat)
            right, more = _extension(doc[at:at + room] == owner[oat:oat + room])
            room = min(s, o)
            left, before = _extension((doc[s - room:s] == owner[o - room:o])[::-1])
            s, o, at, oat, words = s - left, o - left, at + right, oat + right, words + more + before
        return s + a, at + a, o + oa, oat + oa, words

    def alike(found: tuple[int, int, int, int, int]) -> bool:
        return found[4] >= MIN_IDENTITY * max(found[1] - found[0], found[3] - found[2])

    whole = passage(0, len(x) - 1, True)
    if alike(whole):
        out = [whole]
    elif min(whole[1] - whole[0], whole[3] - whole[2]) < MIN_WORDS:
        out = []
    else:
        grown = [(i, j, passage(i, j, True)) for i, j in _windows(np.array(x), np.array(y), total)]
        out = [found if alike(found) else passage(i, j, False) for i, j, found in grown]
    return [found for found in out if min(found[1] - found[0], found[3] - found[2]) >= MIN_WORDS]


PASSAGES = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int, n_matched int"


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, owner, anchors, a, oa, words, owords in zip(*(batch.column(c).to_pylist() for c in ("doc", "owner", "anchors", "a", "oa", "words", "owords"))):
            found = align(np.frombuffer(anchors, "<i4").reshape(2, -1).astype(np.int64), np.frombuffer(words, "<u4"), np.frombuffer(owords, "<u4"), a, oa)
            rows.extend((doc, s, e, owner, os_, oe, matched) for s, e, os_, oe, matched in found)
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "n_matched"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of a document that an earlier one (the source) holds: PASSAGES."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    seeds = map_arrow(rows, _seeder, "h long, doc long, pos int, steps int, lead boolean")
    led = F.when(F.col("lead"), F.col("doc"))
    owners = (seeds.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.min_by("pos", led).alias("opos"))
              .where("owner <> last").drop("last"))
    owners = materialize(owners, "owners")  # so that both sides of the join are dealt anew and a hot seed's partition can be split
    matches = seeds.select("h", "doc", "pos", "steps").join(owners, "h").where("doc <> owner").select("doc", "owner", "pos", "opos", "steps")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = matches.repartition(parts, "doc").sortWithinPartitions("doc", "owner", "pos", "opos")
    found = materialize(map_arrow(dealt, _chainer, _CHAIN), "chains")
    wanted = found.select("doc", "a", "b").union(found.select(F.col("owner").alias("doc"), F.col("oa").alias("a"), F.col("ob").alias("b"))).distinct()
    # (at most (words / GRID)^2 spans of a document, whoever asks)
    spans = wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    read = map_arrow(rows.join(spans, "doc").select("doc", "text", "spans"), _span_reader, "doc long, a int, b int, words binary")
    read = materialize(read.dropDuplicates(["doc", "a", "b"]), "spans")
    owner_words = read.select(F.col("doc").alias("owner"), F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("words").alias("owords"))
    pairs = found.join(read, ["doc", "a", "b"]).join(owner_words, ["owner", "oa", "ob"])
    return map_arrow(pairs, _aligner, PASSAGES)


def _cutter(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            gone: list[bool] = []
            spans = batch.column(batch.num_columns - 1).to_pylist()
            column = batch.column(place)
            nulls = column.is_null().to_pylist()
            for row, rows, data, bounds in wordhash.text_runs(column):
                _, start, end, first = wordhash.words(data, bounds)
                for i in range(rows):
                    text = data[bounds[i]:bounds[i + 1]].tobytes()
                    if spans[row + i]:
                        s, e = start[first[i]:first[i + 1]] - bounds[i], end[first[i]:first[i + 1]] - bounds[i]
                        text = cut(text, s, e, [(x["a"], x["b"]) for x in spans[row + i]])
                    gone.append(bool(spans[row + i]) and not text.strip(wordhash.SEPARATORS))
                    out.append(None if nulls[row + i] else text.decode("utf-8"))
            kept = batch.select(range(batch.num_columns - 1))
            kept = kept.set_column(place, kept.schema.field(place), pa.array(out, pa.string()).cast(kept.schema.field(place).type))
            yield kept.filter(pa.array([not x for x in gone], pa.bool_()))
    return run


def cut(text: bytes, start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and the separators between them)."""
    out, at = [], 0
    for a, b in sorted(spans):
        b = min(b, len(start))
        if a >= len(start):
            continue
        if start[a] > at:
            out.append(text[at:start[a]])
        at = max(at, int(end[b - 1]))
    out.append(text[at:])
    return b"".join(out)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) without the words of repeated passages; a document of which no word is left goes."""
    spans = (repeated_passages(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__doc"))
             .agg(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("__spans")))
    both = docs.join(spans, F.col(id_col).cast("long") == F.col("__doc"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    return map_arrow(both, _cutter(docs.columns.index(text_col)), docs.schema)
