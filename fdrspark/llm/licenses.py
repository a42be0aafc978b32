"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import hot_keys, left_join_present, slices, stored, table, texts, trimmed
from fdrspark.llm.license_texts import TEMPLATES

#: Least cosine of a notice to count.
LEAST = 0.6
#: Words in at least this share of the texts go to every task (200 times a text's different words at the most); others are joined.
COMMON = 0.005
#: Up to so many folders with a licence of their own are broadcast; more are joined by a shuffle.
BROADCAST_DIRS = 10_000
#: Different words that a task counts before it passes its counts on.
HELD_WORDS = 500_000

_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_NAMED = re.compile(r"(?i)^(un)?licen[cs]e(\..*)?$|^copying(\..*)?$|^notice(\..*)?$")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Matcher:
    """Cosine of a text to templates; weights are (1 + ln tf) * idf; words that ``df`` lacks and no ``more`` gives weigh as ones that no text has."""

    def __init__(self, templates, df: dict[str, int], n: int, least: float = LEAST):
        self.names = [name for name, _ in templates]
        self.least = least
        bags = [Counter(tokens(t)) for _, t in templates]
        self.n = n
        self.idf = {w: self.weight(df.get(w, 0)) for w in {*df, *(w for b in bags for w in b)}}
        self.new = self.weight(0)
        self.rows = []
        for b in bags:
            row = {w: (1 + np.log(c)) * self.idf[w] for w, c in b.items()}
            norm = np.sqrt(sum(x * x for x in row.values()))
            self.rows.append({w: float(x / norm) for w, x in row.items()})
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, r in enumerate(self.rows):
            for w, x in r.items():
                self.by_word.setdefault(w, []).append((i, x))
        # A text without these words of a template has a cosine below the least: what they leave of its norm is too short.
        self.anchors = set()
        for r in self.rows:
            left = 1.0
            for w, x in sorted(r.items(), key=lambda p: (-p[1], p[0])):
                if left < least * least:
                    break
                self.anchors.add(w)
                left -= x * x

    def weight(self, df: int) -> float:
        """The idf of a word that stands in so many texts."""
        return float(np.log((1 + self.n) / (1 + df))) + 1

    def unweighed(self, text: str) -> list[str] | None:
        """The words whose idf a scan of the text still needs; None if it holds no anchor, and so no notice."""
        words = set(tokens(text))
        return sorted(words - self.idf.keys()) if words & self.anchors else None

    def best(self, text: str, more: dict[str, float] = {}) -> tuple[float, int]:  # noqa: B006
        """The highest cosine and its template (the first of equals); (0, -1) if there is none. ``more`` has the idf of further words."""
        bag = Counter(tokens(text))
        if not bag.keys() & self.anchors:
            return 0.0, -1
        norm, dots = 0.0, {}
        for w, c in bag.items():
            x = (1 + float(np.log(c))) * (self.idf.get(w) or more.get(w, self.new))
            norm += x * x
            for i, y in self.by_word.get(w, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        if not dots:
            return 0.0, -1
        i = min(dots, key=lambda k: (-dots[k], k))
        return dots[i] / norm**0.5, i

    def best_run(self, lines: list[list[str]], more: dict[str, float], best: float) -> tuple[float, int, bool] | None:
        """The run of neighbouring lines whose cosine is highest, its template, and whether it stands first; None if none beats ``best``.

        A run grows from each line until its words outside a template outweigh, for
        every template, all that the text has of it: from there on no cosine beats the best.
        """
        whole = Counter(w for ws in lines for w in ws)
        idf = {w: self.idf.get(w) or more.get(w, self.new) for w in whole}
        top = [(i, sum(((1 + math.log(whole[w])) * idf[w]) ** 2 for w in r.keys() & whole.keys())) for i, r in enumerate(self.rows)]
        found = None
        for a, first in enumerate(lines):
            if best > 1 - 1e-6:
                break
            if not any(w in self.by_word for w in first):
                continue
            bag, norm, dots, inner = {}, 0.0, {}, [0.0] * len(self.rows)
            for b in range(a, len(lines)):
                for w in lines[b]:
                    c = bag[w] = bag.get(w, 0) + 1
                    x = (1 + math.log(c)) * idf[w]
                    old = (1 + math.log(c - 1)) * idf[w] if c > 1 else 0.0
                    norm += x * x - old * old
                    for i, y in self.by_word.get(w, ()):
                        dots[i] = dots.get(i, 0.0) + (x - old) * y
                        inner[i] += x * x - old * old
                i = min(dots, key=lambda k: (-dots[k], k))
                if b > a and dots[i] / norm**0.5 > best + 1e-9:
                    best = dots[i] / norm**0.5
                    found = best, i, a == 0
                if all(t * (1 - best * best) <= best * best * (norm - inner[i]) for i, t in top):
                    break
        return found

    def scan(self, text: str, more: dict[str, float] = {}) -> tuple[str | None, float, bool]:  # noqa: B006
        """(licence, cosine, leads) of a whole text: its best line, paragraph, run of neighbouring lines, or all of it; whether that stands first.

        A cosine below the least is that of the best line or paragraph, or of all the text.
        """
        if not set(tokens(text)) & self.anchors:
            return None, 0.0, False
        parts, every, first = [], [], True
        for para in re.split(r"\n[\x20\t]*\n", text):
            lines = [x for x in para.split("\n") if x.strip()]
            if not lines:
                continue
            parts += [(x, first and k == 0) for k, x in enumerate(lines)]
            if len(lines) > 1:
                parts.append((" ".join(lines), first))
            every += lines
            first = False
        if len(every) > 1:
            parts.append((" ".join(every), True))
        found = [(*self.best(p, more), lead) for p, lead in parts]
        score, i, lead = min(found, key=lambda f: (-f[0], not f[2], f[1]), default=(0.0, -1, False))
        run = self.best_run([tokens(x) for x in every], more, max(score, self.least - 1e-9)) if len(every) > 1 else None
        score, i, lead = run or (score, i, lead)
        return (self.names[i], round(score, 6), lead) if score >= self.least else (None, round(score, 6), False)


def document_frequencies(files: DataFrame) -> DataFrame:
    """(word, n): in how many texts each word stands; the row of the empty word has the number of texts. All rows count."""

    def run(batches):
        count, n = Counter(), 0
        for batch in (part for b in batches for part in slices(b, 0)):
            n += batch.num_rows
            for t in texts(batch, 0):
                count.update(set(tokens(t)))
            if len(count) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])
                count = Counter()
        yield pa.RecordBatch.from_arrays([pa.array([*count, ""], pa.string()), pa.array([*count.values(), n], pa.int64())], names=["word", "n"])

    return files.select("text").mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scan_files(files: DataFrame, *, templates=TEMPLATES, least: float = LEAST, common: float = COMMON) -> DataFrame:
    """Licences of files (id, path, text): own by notice, else by the nearest directory above that has one.

    Returns id, path, own_license, own_score, license, license_dir and steps (0:
    own; n: from n directories above). A file speaks for its directory if it is
    named like a licence file or its notice stands first; of several that do, the
    one of the highest cosine, then of the least path. Null texts count as empty
    and have no notice; a null path lies in no directory, and inherits nothing.
    The folder that relative paths lie in is above all of them, and is named "".
    Rows that repeat a path give a result each, an empty table gives none; texts are
    read whole; other columns, whatever their names, are not read.
    """
    counts = stored(document_frequencies(files), "license_words")
    n = counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    known = sorted({w for _, t in templates for w in tokens(t)})
    df = {r["word"]: r["n"] for r in counts.filter((F.col("word") != "") & ((F.col("n") >= common * n) | F.col("word").isin(known))).collect()}
    matcher = Matcher(templates, df, n, least)

    def named(path: str | None) -> bool:
        return bool(_NAMED.match((path or "").rpartition("/")[2]))

    # Rows whose words are all weighed are settled; the others keep the name of their text, and the text.
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 2)):
            out = []
            for t in texts(batch, 2):
                new = matcher.unweighed(t)
                out.append((None, 0.0, False, hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), t, new) if new else (*(matcher.scan(t) if new is not None else (None, 0.0, False)), None, None, None))
            cols = list(zip(*out, strict=True))
            types = [pa.string(), pa.float64(), pa.bool_(), pa.binary(), pa.string(), pa.list_(pa.string())]
            is_named = pa.array([named(p) for p in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), is_named, *map(pa.array, cols, types)], names=["id", "path", "named", "own_license", "own_score", "lead", "key", "text", "words"])

    def settle(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            out = [matcher.scan(t, {x["word"]: matcher.weight(x["n"]) for x in ws}) for t, ws in zip(texts(batch, 1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["key2", "lic2", "score2", "lead2"])

    f = files.select("id", "path", "text")
    first = stored(f.mapInArrow(trimmed(run), f"id {f.schema['id'].dataType.simpleString()}, path string, named boolean, own_license string, own_score double, lead boolean, key binary, text string, words array<string>"), "license_texts")
    unsettled = first.filter("key IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"), F.first("words").alias("words"))
    # Words of the join stand in less than the share ``common`` of the texts, so none is hot.
    weighed = unsettled.select("key", F.explode("words").alias("word")).join(counts, "word").groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("word", "n")).alias("weighed"))
    settled = stored(unsettled.join(weighed, F.col("key") == F.col("k")).select("key", "text", "weighed").mapInArrow(trimmed(settle), "key2 binary, lic2 string, score2 double, lead2 boolean"), "license_scores")
    copies = first.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1000")
    seen = first.select("id", "path", "named", "own_license", "own_score", "lead", "key")
    seen = left_join_present(seen, settled, "key", "key2", hot_keys(copies, "key", "n"), ["id", "path"])
    seen = seen.select("id", "path", F.coalesce("lic2", "own_license").alias("own_license"), F.coalesce("score2", "own_score").alias("own_score"), (F.coalesce("lic2", "own_license").isNotNull() & (F.coalesce("lead2", "lead") | F.col("named"))).alias("speaks"))
    above = F.regexp_replace("path", "/?[^/]*$", "")
    seen = seen.withColumn("dir", F.when(F.col("path").startswith("/") & (above == ""), "/").otherwise(above))
    seen = stored(seen, "license_seen")
    best = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("lic")))
    spoken = seen.filter(F.col("speaks") & F.col("path").isNotNull()).groupBy(F.col("dir").alias("d")).agg(best.alias("b")).select("d", F.col("b.lic").alias("dir_license"))
    # Each directory looks up its ancestors, the folder that all relative paths lie in being the last; as many rows as it has levels.
    parts = F.split("dir", "/")
    levels = F.sequence(F.lit(0), F.size(parts) - 1)
    whole = lambda a: F.when(F.col("dir").startswith("/") & (a == ""), "/").otherwise(a)
    above = F.transform(levels, lambda k: F.struct(k.alias("steps"), whole(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/")).alias("a")))
    root = F.array(F.struct(F.size(parts).alias("steps"), F.lit("").alias("a")))
    above = F.when((F.col("dir") == "") | F.col("dir").startswith("/"), above).otherwise(F.concat(above, root))
    counts = stored(seen.filter("path IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n")), "license_dirs")
    up = counts.select("dir", F.explode(above).alias("x")).select("dir", "x.steps", "x.a")
    near = F.broadcast(spoken) if spoken.count() <= BROADCAST_DIRS else spoken
    near = up.join(near, up["a"] == near["d"]).groupBy(F.col("dir").alias("dir2")).agg(F.min(F.struct("steps", "a", "dir_license")).alias("n"))
    got = left_join_present(seen, near, "dir", "dir2", hot_keys(counts, "dir", "n"), ["id", "path"])
    own = F.col("own_license").isNotNull()
    return got.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "n.dir_license").alias("license"), F.when(~own, F.col("n.a")).alias("license_dir"), F.when(own, 0).otherwise(F.col("n.steps") + 1).alias("steps"))


def path_of(doc_id: Column, source: Column) -> Column:
    """A document as a file: the source is its top folder, thousands and fifties of ids are the folders below.

    Every tenth document is a file NOTICE of the folder of its thousand, every
    hundredth one of its source's folder; a notice in them speaks for these folders.
    """
    level = lambda n: F.floor(doc_id / n).cast("long").cast("string")
    name = doc_id.cast("string")
    top = F.coalesce(source, F.lit("none"))
    return (
        F.when(doc_id % 100 == 0, F.concat_ws("/", top, F.concat(F.lit("NOTICE."), name)))
        .when(doc_id % 10 == 0, F.concat_ws("/", top, level(1000), F.concat(F.lit("NOTICE."), name)))
        .otherwise(F.concat(top, F.lit("/"), level(1000), F.lit("/"), level(50), F.lit("/"), name, F.lit(".txt")))
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = path_of(F.col("doc_id"), F.col("source"))
    return scan_files(d.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")
