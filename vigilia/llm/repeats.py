"""Removing word sequences that stand earlier in the corpus, by recompression.

A text is a row of word names. First runs of one word get a name, then rounds of
pair naming follow: in each round every symbol falls on one of two sides by its
name, and a left symbol followed by a right one becomes a new symbol named after
the two. Names are hashes of what they stand for, so they agree over the whole
corpus without exchange: wherever the same words stand, the symbols inside are
the same, but for those near the ends, where the neighbours had a say. Each
symbol carries the stretch of words that decides its existence. A window of
``WIDTH`` words is represented by one symbol decided within it; equal
windows have the same one, so one shuffle by symbol brings every repeat together,
with a row for each symbol and not for each window. Stretches of windows that
share an occurrence are compared whole; windows are hashed one by one only where
a symbol stands in differing surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilia.llm import arrays
from vigilia.llm.arrays import U
from vigilia.llm.tables import shared_ids, stored, text_key

WIDTH = 20
_CUT = U(24)
ROUNDS = 7
#: Words a symbol spans to represent a window, the preferred sizes first: few
#: enough that many windows share one, and enough to be rare by chance.
_SIZES = ((4, 6), (2, 3))


def symbols(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(name, start, end, lo, hi) of all named runs and pairs: the words they
    span, end exclusive, and those that decide them, hi inclusive."""
    n = len(h)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(n)
    begins = np.ones(n, dtype=bool)
    begins[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n) if n else start
    length = end - start
    name = np.where(length > 1, arrays.combine(h[start], length.astype(U)), h[start])
    owner = text[start]
    lo, hi = place[start] - 1, end.copy()  # a word more on each side: it is another one
    made = [tuple(x[length > 1] for x in (name, start, end, lo, hi))]
    for r in range(ROUNDS):
        if len(name) < 2:
            break
        left = (arrays.mix(name ^ U((r + 1) * 0x632BE59BD9B4E019 % 2**64)) >> U(63)).astype(bool)
        same = owner[1:] == owner[:-1]
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & same
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair[:-1]
        # Alone for want of a partner: the neighbour that is none decides as well.
        after, before = np.append(hi[1:], n + width), np.concatenate(([-width], lo[:-1]))
        after[:-1][~same] = n + width
        before[1:][~same] = -width
        hi = np.where(left & ~pair, after, hi)
        lo = np.where(~left & ~second, before, lo)
        i = np.flatnonzero(pair)
        named = (arrays.combine(name[i] + U(r), name[i + 1]), start[i], end[i + 1], lo[i], hi[i + 1])
        made.append(tuple(x[named[4] - named[3] < width] for x in named))
        keep = ~second
        name, start, end, lo, hi, owner = (x.copy() for x in (name, start, end, lo, hi, owner))
        name[i], start[i], end[i], lo[i], hi[i] = named
        name, start, end, lo, hi, owner = (x[keep] for x in (name, start, end, lo, hi, owner))
    return tuple(np.concatenate(x) for x in zip(*made))


def stretches(h: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, symbol name, first window, windows) for all windows of all texts:
    consecutive windows represented by the same occurrence of a symbol."""
    n = len(h)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.arange(n) + width <= first[1:][text]
    name, start, end, lo, hi = symbols(h, first, width)
    size = end - start
    # Best: of the preferred sizes, least name, then leftmost. The last assignment stays.
    order = np.lexsort((start, name))[::-1]
    name, start, size, lo, hi = (x[order] for x in (name, start, size, lo, hi))
    lo = np.maximum(lo, -1)
    best = np.full(n, -1)
    for least, most in _SIZES:
        some = np.flatnonzero((size >= least) & (size <= most))
        if (least, most) != _SIZES[0]:  # only where something is still to be represented
            open_ = np.concatenate(([0], np.cumsum(valid & (best < 0))))
            some = some[open_[lo[some] + 1] > open_[np.maximum(hi[some] - width + 1, 0)]]
        low = np.maximum(hi[some] - width + 1, 0)
        count = np.maximum(lo[some] - low + 1, 0)
        which = np.repeat(some, count)
        window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        if (least, most) != _SIZES[0]:
            free = best[window] < 0
            which, window = which[free], window[free]
        best[window] = which
    alone = np.flatnonzero(valid & (best < 0))
    words = np.full(n, -1)
    if len(alone):  # no symbol inside: the least word stands for the window
        for a in range(0, len(alone), 100_000):
            some = alone[a:a + 100_000]
            words[some] = some + h[some[:, None] + np.arange(width)].argmin(axis=1)
    windows = np.flatnonzero(valid)
    at = np.where(best >= 0, best, len(name) + words)[windows]
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none, none
    breaks = np.ones(len(windows), dtype=bool)
    breaks[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    i = np.flatnonzero(breaks)
    count = np.diff(np.append(i, len(windows)))
    chosen, begin = at[i], windows[i]
    known = chosen < len(name)
    names = np.empty(len(i), U)
    names[known] = name[chosen[known]]
    names[~known] = h[chosen[~known] - len(name)]
    return text[begin], names, begin, count


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.utf8(batch.column("text"))
    starts, ends, first = arrays.words(data, offsets)
    return arrays.word_hashes(data, starts, ends), first


_PLACE = "doc_id bigint, version bigint, start int, windows int"


def _occurrences(width: int):
    """Rows (name, whole, known, doc_id, version, start, windows). Of equal
    stretches in one piece of a batch only the earliest goes on; the others are
    known to repeat it, their place alone matters, and they are dealt by document.
    Names take 40 bits and whole stretches 56: a stretch is told by both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in arrays.slices(whole_batch):
                h, first = _hashed(batch)
                text, name, start, windows = stretches(h, first, width)
                whole = arrays.Spans(h).hash(start, start + windows + width - 1) >> U(8)
                name = name >> _CUT
                ids = batch.column("doc_id").to_numpy()
                version = batch.column("version").to_numpy()[text]
                inside = start - first[text]
                order = np.lexsort((inside, ids[text], whole, name))
                n, w = name[order], whole[order]
                again = np.zeros(len(order), dtype=bool)
                again[1:] = (n[1:] == n[:-1]) & (w[1:] == w[:-1])
                # Rows of one place (a repeated document) are no repeats of each other.
                head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order)))) if len(order) else order
                o, f = order, order[head]
                again &= (ids[text][o] != ids[text][f]) | (inside[o] != inside[f])
                n = np.where(again, arrays.mix(ids[text][o].astype(U)) >> _CUT, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (n.view(np.int64), w.view(np.int64), again, ids[text][o], version[o],
                                           inside[o].astype(np.int32), windows[o].astype(np.int32))],
                    ["name", "whole", "known", "doc_id", "version", "start", "windows"])
    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (name, whole, doc_id, start): stretches that repeat an
    earlier equal one (sure), and the first of each kind where a symbol has
    several kinds (not sure). State between batches is a row or two."""
    names = ["name", "doc_id", "version", "start", "windows"]
    last = None  # (name, whole, doc_id, start) of the first row of the current kind
    waiting = None  # the first row of a symbol that has one kind so far

    def rows(batch, chosen, sure):
        part = batch.select(names).filter(pa.array(chosen))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, sure))], [*names, "sure"])

    for batch in batches:
        if not batch.num_rows:
            continue
        name, whole, doc, start = (batch.column(c).to_numpy() for c in ("name", "whole", "doc_id", "start"))
        known = batch.column("known").to_numpy(zero_copy_only=False)
        yield rows(batch, known, True)
        live = np.flatnonzero(~known)
        if not len(live):
            continue
        n, w, d, s = name[live], whole[live], doc[live], start[live]
        previous = last or (None, None, None, None)
        new_kind = np.ones(len(live), dtype=bool)
        new_kind[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
        new_kind[0] = (n[0], w[0]) != previous[:2]
        head = np.maximum.accumulate(np.where(new_kind, np.arange(len(live)), -1))
        head_d = np.where(head >= 0, d[head], previous[2] if last else 0)
        head_s = np.where(head >= 0, s[head], previous[3] if last else 0)
        chosen = np.zeros(batch.num_rows, dtype=bool)
        chosen[live] = ~new_kind & ((d != head_d) | (s != head_s))
        yield rows(batch, chosen, True)
        kinds = np.flatnonzero(new_kind)
        if len(kinds):
            follows = n[kinds[1:]] == n[kinds[:-1]]
            joined = bool(last) and n[kinds[0]] == previous[0]
            if joined and waiting is not None:
                yield rows(waiting, np.array([True]), False)
            several = np.concatenate(([joined], follows))
            several[:-1] |= follows
            chosen = np.zeros(batch.num_rows, dtype=bool)
            chosen[live[kinds[several]]] = True
            yield rows(batch, chosen, False)
            waiting = None if several[-1] else batch.slice(int(live[kinds[-1]]), 1)
        h = head[-1]
        last = (n[-1], w[-1], *((d[h], s[h]) if h >= 0 else previous[2:]))


def _windows(width: int):
    """The single windows of the stretches in ``asked``, (name, window hash, place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole):
                h, first = _hashed(batch)
                asked = batch.column("asked").to_pylist()
                spans = arrays.Spans(h)
                ids, version = (batch.column(c).fill_null(0).to_numpy() for c in ("doc_id", "version"))
                rows = np.array([(i, a["name"], a["start"], a["windows"]) for i, some in enumerate(asked) for a in some or ()],
                                dtype=np.int64).reshape(-1, 4)
                text, name, start, count = (np.repeat(c, rows[:, 3]) for c in rows.T)
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(rows[:, 3]) - rows[:, 3], rows[:, 3])
                at = first[text] + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (name, spans.hash(at, at + width).view(np.int64), ids[text], version[text],
                                           start.astype(np.int32))],
                    ["name", "whole", "doc_id", "version", "start"])
    return run


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (name, whole, doc_id, start): windows that are not the first equal one."""
    last = (None,) * 4
    for batch in batches:
        if not batch.num_rows:
            continue
        name, whole, doc, start = (batch.column(c).to_numpy() for c in ("name", "whole", "doc_id", "start"))
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])
        new[0] = (name[0], whole[0]) != last[:2]
        head = np.maximum.accumulate(np.where(new, np.arange(len(name)), -1))
        head_d, head_s = (np.where(head >= 0, x[head], old or 0) for x, old in ((doc, last[2]), (start, last[3])))
        later = ~new & ((doc != head_d) | (start != head_s))
        part = batch.select(["doc_id", "version", "start"]).filter(pa.array(later))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.ones(part.num_rows, np.int32))],
                                         ["doc_id", "version", "start", "windows"])
        last = (name[-1], whole[-1], head_d[-1], head_s[-1])


def _once(texts: DataFrame) -> DataFrame:
    """Repeated rows once. Only texts whose key comes several times are compared;
    copies are dropped before they are shuffled."""
    key = ["doc_id", "version"]
    several = stored(texts.groupBy(*key).count().where("count > 1").select(*key), "several")
    return texts.join(several, key, "left_anti").unionByName(texts.join(several, key, "left_semi").dropDuplicates())


def repeated(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, version, start, windows): all windows that also start earlier, as
    consecutive ones from word ``start``; ``version`` is the text's hash.

    Earlier is a smaller doc_id, or the same and an earlier word. Rows of a null
    id take no part; a repeated row does not repeat itself, and its windows are
    given once. ``texts`` is what `versions` gives.
    """
    once = _once(texts.where("doc_id is not null").select("doc_id", "version", "text"))
    found = once.mapInArrow(_occurrences(width), f"name bigint, whole bigint, known boolean, {_PLACE}")
    judged = stored(found.repartition("name").sortWithinPartitions("name", "whole", "doc_id", "start")
                    .mapInArrow(_later, f"name bigint, {_PLACE}, sure boolean"), "stretches")
    asked = judged.where("not sure").groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("name", "start", "windows")).alias("asked"))
    single = (once.join(asked, ["doc_id", "version"])
              .mapInArrow(_windows(width), "name bigint, whole bigint, doc_id bigint, version bigint, start int")
              .repartition("name", "whole").sortWithinPartitions("name", "whole", "doc_id", "start")
              .mapInArrow(_not_first, _PLACE))
    return judged.where("sure").select("doc_id", "version", "start", "windows").unionByName(single)


def versions(docs: DataFrame) -> DataFrame:
    """The rows with ``version``: the key of a row is its id and this. It is 0 but
    for ids that come with several texts, which get their texts' 64-bit hashes."""
    several = shared_ids(docs).select("doc_id").distinct().withColumn("_several", F.lit(True))
    return docs.join(several, "doc_id", "left").withColumn(
        "version", F.when(F.col("_several"), text_key()).otherwise(F.lit(0).cast("bigint"))).drop("_several")


def _without(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, gone = [], [], []
            texts = batch.column("row").field("text").to_pylist()
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                words = (text or "").encode().split()
                drop = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    drop[s["start"]] += 1
                    drop[s["start"] + s["windows"] + width - 1] -= 1
                out = np.cumsum(drop)[:-1] > 0
                counts.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, o in zip(words, out.tolist()) if not o]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["row", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, *keep: str, width: int = WIDTH) -> DataFrame:
    """``keep`` columns, doc_id and text with n_words, n_removed and kept_text: the
    words left, joined by single spaces. Null and empty texts have no words;
    texts shorter than a window keep all. Every row of ``docs`` is returned;
    columns named as the added ones are replaced by them. An id with several
    texts stands for each of them; their windows come in one order of starts."""
    added = ("n_words", "n_removed", "kept_text")
    columns = [c for c in dict.fromkeys(("doc_id", "text", *keep)) if c not in added]
    texts = versions(docs.select("doc_id", "text", F.struct(*columns).alias("row")))
    spans = repeated(texts, width).groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("start", "windows")).alias("spans"))
    rows = texts.join(spans, ["doc_id", "version"], "left").select("row", "spans")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_without(width), f"row {kind}, n_words bigint, n_removed bigint, kept_text string").select(
        "row.*", *added)
