"""Removal of repeated passages, found by recompression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import WordNames, hot_keys, join_split, mix, pair_name, slices, stored, table, text_digest, texts, trimmed, words_of

WINDOW = 35
#: What each round names: runs of one symbol, or pairs. Names are hashes of what they name, so all tasks agree on them.
ROUNDS = "rppp"
#: So many neighbouring symbols of the last round make an anchor.
SPAN = 3


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """The name of each stretch of ``size`` symbols, a power of 2; the last ones, which would pass the end, mean nothing."""
    h, n = names, 1
    while n < size:
        h = pair_name(h, np.concatenate([h[n:], h[:n]]) if len(h) > n else h, 100 + n)
        n *= 2
    return h


def window_names(names: np.ndarray, window: int) -> np.ndarray:
    """A name for the window that starts at each word: two stretches of a power of 2 that cover it."""
    size = 1 << (window.bit_length() - 1)
    h = doubled(names, size)
    gap = window - size
    return pair_name(h, np.concatenate([h[gap:], h[:gap]]) if len(h) > gap else h, 300 + window)


def starts_of(sizes: np.ndarray, window: int) -> np.ndarray:
    """Places at which a window starts, in documents of these sizes laid end to end."""
    n = np.maximum(sizes - window + 1, 0)
    first = np.cumsum(sizes) - sizes
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def shortened(sym: np.ndarray, doc: np.ndarray, kind: str, level: int):
    """(new symbols, where each symbol went, where each new one begins, half) of a round; half is null for runs.

    A run of a symbol, or a pair whose first symbol falls into one half of all
    symbols and whose second into the other, becomes one symbol; a symbol alone
    stays itself.
    """
    if kind == "r":
        fresh = np.ones(len(sym), bool)
        fresh[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        into, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        long = np.diff(np.append(at, len(sym)))
        new = sym[at]
        many = long > 1
        new[many] = pair_name(new[many], long[many].astype(np.uint64), 500 + level)
        return new, into, at, None
    bit = (mix(sym, 700 + level) >> np.uint64(63)).astype(np.int64)
    joins = np.zeros(len(sym), bool)  # with the symbol before
    joins[1:] = (bit[:-1] == 0) & (bit[1:] == 1) & (doc[1:] == doc[:-1])
    into, at = np.cumsum(~joins) - 1, np.flatnonzero(~joins)
    new = sym[at]
    second = np.flatnonzero(joins)
    new[into[second]] = pair_name(sym[second - 1], sym[second], 600)
    return new, into, at, bit


def anchors(names: np.ndarray, sizes: np.ndarray, window: int, rounds: str = ROUNDS):
    """(starts, name, place) of all windows: symbols that any equal window has at the same distance, and where they begin.

    Each round shortens all documents by naming runs of a symbol, or pairs whose
    first symbol falls into one half of all symbols and whose second into the
    other, by a hash. What a window's edges might share with their neighbours is
    given up: the runs at both ends, a first symbol that can be the second of a
    pair, a last that can be the first of one. The symbols between are a function
    of the window alone. A window's anchor is taken from the last round that
    leaves it SPAN symbols or more: of all SPAN in a row those of the least hash,
    the first of equals. Windows next to each other mostly share it.
    """
    starts = starts_of(sizes, window)
    name = np.zeros(len(starts), np.uint64)
    place = np.zeros(len(starts), np.int64)
    if not len(starts):
        return starts, name, place
    sym, pos = names, np.arange(len(names))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    live, first, last = np.arange(len(starts)), starts.copy(), starts + window - 1

    def settle(which, first, last, level):
        """Anchors of windows that have symbols first to last in this round and too few in the next."""
        g = sym
        for k in range(1, SPAN):
            g = pair_name(g[:-1], sym[k:], 900 + k)
        low = mix(g, 1000 + level)
        # least[k][i]: where the least of low[i : i + 2**k] stands
        least, width = [np.arange(len(g))], last - first + 2 - SPAN
        while 2 << (len(least) - 1) <= width.max():
            half, at = 1 << (len(least) - 1), least[-1]
            x, y = at[:-half], at[half:]
            least.append(np.where(low[x] <= low[y], x, y))
        best = np.empty(len(first), np.int64)
        power = np.frexp(width)[1] - 1
        for k, at in enumerate(least):
            some = np.flatnonzero(power == k)
            if len(some):
                x, y = at[first[some]], at[first[some] + width[some] - (1 << k)]
                best[some] = np.where(low[x] <= low[y], x, y)
        name[which] = low[best]
        place[which] = pos[best]

    for level, kind in enumerate(rounds):
        new, into, at, bit = shortened(sym, doc, kind, level)
        if bit is None:
            f, t = into[first] + 1, into[last] - 1
        else:
            f, t = into[first] + bit[first], into[last] - 1 + bit[last]
        empty = t - f < SPAN - 1
        if empty.any():
            settle(live[empty], first[empty], last[empty], level)
        go = ~empty
        live, first, last = live[go], f[go], t[go]
        sym, pos, doc = new, pos[at], doc[at]
        if not len(live):
            break
    if len(live):
        settle(live, first, last, len(rounds))
    return starts, name, place


def regions(names: np.ndarray, sizes: np.ndarray, window: int):
    """(start, windows, anchor name, content name): stretches of neighbouring windows with one anchor.

    Equal content names mean equal words, hence equal windows all through.
    """
    starts, name, place = anchors(names, sizes, window)
    if not len(starts):
        return starts, starts, name, name
    half = 1 << (window.bit_length() - 1)
    most = 2 * half - window + 1  # so that two stretches of ``half`` words cover the region
    cut = np.ones(len(starts), bool)
    cut[1:] = (starts[1:] != starts[:-1] + 1) | (place[1:] != place[:-1]) | (name[1:] != name[:-1])
    run = np.flatnonzero(cut)[np.cumsum(cut) - 1]
    at = np.flatnonzero((np.arange(len(starts)) - run) % most == 0)
    m = np.diff(np.append(at, len(starts)))
    s = starts[at]
    h = doubled(names, half)
    content = pair_name(h[s], h[s + m + window - 1 - half], 800)
    return s, m, name[at], mix(content ^ mix(m.astype(np.uint64), 801), 802)


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, text: rows alike in id and in the digest h are alike in text, so that results can be carried back to them."""
    return docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("h"), F.col(text_col).alias("text"))


def _named(batch, column, words_memo):
    ws = [words_of(t) for t in texts(batch, column)]
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    return ws, sizes, words_memo.of([w for x in ws for w in x])


def name_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: str = ROUNDS) -> DataFrame:
    """(round, name, a, b): what each name of each round stands for, over all documents: a pair of symbols, or a symbol and its count.

    This is the global table that rounds of naming with tables would build: one
    row a name if no two things share a name, which the grouping by name shows. The
    names being hashes of what they name, tasks agree on them without looking the
    table up, and the rounds need no exchange of symbols.
    """

    def run(batches):
        memo = WordNames()
        for batch in batches:
            for part in slices(batch, 2):
                _, sizes, sym = _named(part, 2, memo)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for level, kind in enumerate(rounds):
                    new, _, at, bit = shortened(sym, doc, kind, level)
                    stop = np.append(at[1:], len(sym))
                    made = np.flatnonzero(stop - at > 1)
                    b = sym[at[made] + 1] if bit is not None else (stop - at)[made].astype(np.uint64)
                    table = np.unique(np.stack([new[made], sym[at[made]], b], axis=1), axis=0).view(np.int64) if len(made) else np.zeros((0, 3), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(table), level, np.int32)), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)]], names=["round", "name", "a", "b"])
                    sym, doc = new, doc[at]

    return _key(docs, id_col, text_col).mapInArrow(trimmed(run), "round int, name long, a long, b long").distinct()


def find_regions(keyed: DataFrame, window: int) -> DataFrame:
    """(name, content, id, h, s, m) of every document's regions."""
    id_type = keyed.schema["id"].dataType.simpleString()

    def run(batches):
        memo = WordNames()
        for batch in batches:
            for part in slices(batch, 2):
                _, sizes, names = _named(part, 2, memo)
                s, m, name, content = regions(names, sizes, window)
                edge = np.cumsum(sizes) - sizes
                doc = np.searchsorted(edge + sizes, s, side="right")
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array((s - edge[doc]).astype(np.int32)), pa.array(m.astype(np.int32))], names=["name", "content", "id", "h", "s", "m"])

    return keyed.mapInArrow(trimmed(run), f"name long, content long, id {id_type}, h binary, s int, m int")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(name, w, id, h, s, lone): the windows of the listed regions of each document, with names of their own."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        memo = WordNames()
        for batch in batches:
            for part in slices(batch, 2):
                _, sizes, names = _named(part, 2, memo)
                edge = np.cumsum(sizes) - sizes
                asked = part.column(3)
                doc = np.repeat(np.arange(part.num_rows), np.asarray(asked.value_lengths()))
                flat = asked.flatten()
                s, m, name, lone = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False)) for k in ("s", "m", "name", "lone"))
                if not len(s):
                    continue
                h = window_names(names, window)
                inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                at = np.repeat(s, m) + inner
                who = np.repeat(doc, m)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, m)), pa.array(h[edge[who] + at].view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(np.repeat(lone, m))], names=["name", "w", "id", "h", "s", "lone"])

    return rows.mapInArrow(trimmed(run), f"name long, w long, id {id_type}, h binary, s int, lone boolean")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept): words covered by the listed windows taken out."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            n, gone, kept = [], [], []
            for text, spans in zip(texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                ws = words_of(text)
                keep = ws
                if spans:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    s = np.array([x["s"] for x in spans])
                    m = np.array([x["m"] for x in spans])
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + m + window - 1, -1)
                    keep = [w for w, c in zip(ws, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                n.append(len(ws))
                gone.append(len(ws) - len(keep))
                kept.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(trimmed(run), f"id {id_type}, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and kept (the words left, joined by one space), one row per row of docs.

    A word goes if a window of ``window`` words covers it whose word sequence also
    starts at any other place, of the same document or another. Windows are those
    of the input. Recompression gives each window an anchor; windows can be equal
    only if their anchors' names are. Stretches of windows with one anchor are
    compared as wholes first; where stretches share an anchor but not all words,
    as at the ends of a repeated passage, one of each kind is taken apart into
    windows, which are compared by 64-bit names of all their words besides the
    anchor's. Null and empty texts have no words, shorter texts than a window lose
    none; repeated rows are places of their own and so repeat each other; null ids
    are told apart by their texts. An empty table gives no rows, and other columns,
    whatever their names, are not read.
    """
    keyed = _key(docs, id_col, text_col)
    found = stored(find_regions(keyed, window), "regions")
    names = stored(found.groupBy(F.col("name").alias("name2")).agg(F.count("*").alias("n")).filter("n > 1"), "names")
    shared = stored(join_split(found, names, "name", "name2", hot_keys(names, "name2", "n"), ["id", "h", "s"], "left_semi"), "shared")
    kinds = stored(shared.groupBy("name", "content").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "s", "m")).alias("one")), "kinds")
    mixed = stored(kinds.groupBy(F.col("name").alias("name2")).agg(F.count("*").alias("n")).filter("n > 1"), "mixed")
    same = lambda a, b: a["id"].eqNullSafe(b["id2"]) & (a["h"] == b["h2"])

    apart = join_split(kinds, mixed, "name", "name2", hot_keys(mixed, "name2", "n"), ["content"], "left_semi")
    asked = apart.groupBy(F.col("one.id").alias("id2"), F.col("one.h").alias("h2")).agg(F.collect_list(F.struct(F.col("one.s").alias("s"), F.col("one.m").alias("m"), "name", (F.col("c") == 1).alias("lone"))).alias("asked"))
    apart = keyed.join(asked.hint("shuffle_hash"), same(keyed, asked)).select("id", "h", "text", "asked")
    apart = stored(_windows(apart, window), "windows")
    twice = stored(apart.groupBy(F.col("name").alias("name2"), F.col("w").alias("w2")).agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    lone = join_split(apart.filter("lone"), twice, "w", "w2", hot_keys(twice, "w2", "n"), ["id", "h", "s"], "left_semi", lambda a, b: a["name"] == b["name2"])
    lone = lone.select("id", "h", "s", F.lit(1).alias("m"))

    whole = kinds.filter("c > 1").select(F.col("name").alias("name2"), F.col("content").alias("content2"), "c")
    whole = join_split(shared, whole, "content", "content2", hot_keys(whole, "content2", "c"), ["id", "h", "s"], "left_semi", lambda a, b: a["name"] == b["name2"]).select("id", "h", "s", "m")
    gone = whole.unionByName(lone).groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.collect_set(F.struct("s", "m")).alias("spans"))
    cut = keyed.join(gone.hint("shuffle_hash"), same(keyed, gone), "left").select("id", "text", "spans")
    return _cut(cut, window).withColumnRenamed("id", id_col)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: All windows as texts, which tables of the sample sizes allow.
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM x JOIN twice USING (h)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""
