"""Language ID by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.llm.common import carried_of, fold_of, slices, stored, table, texts, trimmed, with_carried

#: Bytes of a stretch that get their labels from it, bytes around them that it reads besides, and stretches that go side by side.
CORE, MARGIN, STRETCHES = 224, 16, 512
#: Bytes of a stretch in training. Bounds of the training sample: documents of each language, stretches of each of them, and stretches of a language that the network learns from.
LEARN, SAMPLE_DOCS, SAMPLE_STRETCHES, LEARNT = 48, 300, 16, 1500
HIDDEN, EPOCHS = 16, 4
#: Up to so many languages their counts are broadcast.
BROADCAST_LANGS = 10_000
UNDETERMINED = "und"


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class BiGRU:
    """Two GRUs, left to right and right to left, and a softmax at each byte."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, c = hidden, len(classes)
        self.classes, self.hidden = classes, h
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"out": draw(2 * h, c, scale=(2 * h) ** -0.5), "bias": np.zeros(c, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(256, 3 * h, scale=0.3), f"u{d}": draw(h, 3 * h, scale=h**-0.5)}
            self.p[f"x{d}"][:, :h] += 0.5  # gates that keep, at first

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States after each byte of x (time, batch), and what the way back needs."""
        h, wx, u = self.hidden, self.p[f"x{d}"], self.p[f"u{d}"]
        s = np.zeros((x.shape[1], h), np.float32)
        states, caches = [], []
        for t in range(x.shape[0]):
            a, b = wx[x[t]], s @ u
            g = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            new = n + z * (s - n)
            if keep:
                caches.append((s, z, r, n, b[:, 2 * h :]))
            s = new
            states.append(s)
        return np.stack(states), caches

    def probabilities(self, x: np.ndarray, keep: bool = False):
        """(time, batch, class) probabilities of bytes (time, batch)."""
        f, cf = self._run(x, "f", keep)
        b, cb = self._run(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        y = both @ self.p["out"] + self.p["bias"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True), both, cf, cb

    def gradients(self, x: np.ndarray, label: np.ndarray):
        """Loss and its gradients, back through all bytes of the stretches x (time, batch)."""
        p, both, cf, cb = self.probabilities(x, keep=True)
        T, B, C = p.shape
        at = np.arange(B)
        loss = -np.log(p[:, at, label] + 1e-12).mean()
        dy = p.copy()
        dy[:, at, label] -= 1
        dy /= T * B
        h = self.hidden
        g = {"out": np.tensordot(both, dy, ([0, 1], [0, 1])), "bias": dy.sum((0, 1))}
        ds = dy @ self.p["out"].T
        for d, caches, xs, up in (("f", cf, x, ds[:, :, :h]), ("b", cb, x[::-1], ds[::-1, :, h:])):
            u = self.p[f"u{d}"]
            gx, gu, pres = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.empty((T, B, 3 * h), np.float32)
            back = np.zeros((B, h), np.float32)
            for t in range(T - 1, -1, -1):
                s, z, r, n, bn = caches[t]
                e = up[t] + back
                dn = e * (1 - z) * (1 - n * n)
                dz = e * (s - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                pres[t] = np.concatenate([dz, dr, dn], axis=1)
                inner = np.concatenate([dz, dr, dn * r], axis=1)
                gu += s.T @ inner
                back = e * z + inner @ u.T
            seen = xs.ravel()
            order = np.argsort(seen, kind="stable")
            cuts = np.flatnonzero(np.diff(seen[order], prepend=-1))
            gx[seen[order][cuts]] = np.add.reduceat(pres.reshape(T * B, -1)[order], cuts, axis=0)
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return loss, g

    def fit(self, found: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01, seed: int = 7) -> BiGRU:
        """Adam over batches of stretches of one length, in an order drawn by the seed."""
        rng = np.random.default_rng(seed)
        by = defaultdict(list)
        for i, w in enumerate(found):
            by[len(w)].append(i)
        data = {n: (np.frombuffer(b"".join(found[i] for i in ids), np.uint8).reshape(-1, n), labels[ids]) for n, ids in by.items() if n}
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        total = epochs * sum(-(-len(a) // batch) for a, _ in data.values())
        for _ in range(epochs):
            parts = [(n, c) for n, (a, _) in data.items() for c in np.array_split(rng.permutation(len(a)), -(-len(a) // batch))]
            for k in rng.permutation(len(parts)):
                n, rows = parts[k]
                _, g = self.gradients(data[n][0][rows].T, data[n][1][rows])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                lr = rate * (1 - step / (total + 1)) * min(1.0, 1.0 / (norm + 1e-6))
                for q, a in g.items():
                    m[q] = 0.9 * m[q] + 0.1 * a
                    v[q] = 0.999 * v[q] + 0.001 * a * a
                    self.p[q] -= lr * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
        return self


class Labeller:
    """Labels every byte of texts: the network runs over stretches that overlap, and each byte's label comes from inside one.

    A stretch has CORE bytes to label and MARGIN bytes before and after them, where
    the text has these, so that states reach over words and over the stretches' edges.
    """

    def __init__(self, net: BiGRU):
        self.net, h = net, net.hidden
        self.sides = {}
        c = len(net.classes)
        for d in "fb":
            # A gate's sigmoid is 1 / (1 + exp(-x)) and tanh is 1 - 2 / (1 + exp(2 x)); signs and factors go into the weights.
            scale = np.concatenate([np.full(2 * h, -1, np.float32), np.full(h, 2, np.float32)])
            out = net.p["out"][:h] if d == "f" else net.p["out"][h:]
            # One product gives a step's gates and the labels of the state before it.
            self.sides[d] = np.ascontiguousarray(net.p[f"x{d}"] * scale), np.concatenate([(net.p[f"u{d}"] * scale).T, out.T]).reshape(3 * h + c, h)

    def _logits(self, x: np.ndarray, live: np.ndarray, d: str) -> np.ndarray:
        """(time, class, batch) of bytes (time, batch); at each time the first ``live`` rows have one. States are (hidden, batch).

        Every step writes into the same few arrays, which stay in the cache.
        """
        h, (wx, u) = self.net.hidden, self.sides[d]
        head = np.ascontiguousarray(u[3 * h :])
        T, B = x.shape
        logits = np.zeros((T, len(head), B), np.float32)
        width = 0
        s = np.zeros((h, B), np.float32)
        with np.errstate(over="ignore"):  # an infinite exp gives a gate of 0 or a tanh of 1
            for t in range(T):
                k = int(live[t])
                fresh = k != width
                if fresh:
                    if t:
                        logits[t - 1, :, :width] = head @ s
                    s = np.ascontiguousarray(s[:, :k])
                    rows, a, b = np.empty((k, 3 * h), np.float32), np.empty((3 * h, k), np.float32), np.empty((len(u), k), np.float32)
                    g, n, m, width = a[: 2 * h], a[2 * h :], b[2 * h : 3 * h], k
                np.take(wx, x[t, :k], axis=0, mode="clip", out=rows)
                np.copyto(a, rows.T)
                np.matmul(u, s, out=b)
                if not fresh:
                    logits[t - 1, :, :k] = b[3 * h :]
                g += b[: 2 * h]
                np.exp(g, out=g)
                g += 1
                m /= g[h:]
                n += m
                np.exp(n, out=n)
                n += 1
                np.divide(-2, n, out=n)
                n += 1
                s -= n
                s /= g[:h]
                s += n
        if T:
            logits[T - 1, :, :width] = head @ s
        return logits

    def pooled(self, batch: list[str]) -> np.ndarray:
        """For each text the mean probabilities, then the label counts, over all its bytes; zeros for empty ones."""
        data = [t.encode("utf-8", "surrogatepass") for t in batch]
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        c = len(self.net.classes)
        out = np.zeros((len(batch), 2 * c))
        cores = -(-size // CORE)
        doc = np.repeat(np.arange(len(batch)), cores)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(cores) - cores, cores)) * CORE
        lo, hi = np.maximum(at - MARGIN, 0), np.minimum(at + CORE + MARGIN, size[doc])
        base = (np.cumsum(size) - size)[doc]
        order = np.argsort(lo - hi, kind="stable")  # the longest first
        for k in range(0, len(order), STRETCHES):
            rows = order[k : k + STRETCHES]
            first, n = base[rows] + lo[rows], hi[rows] - lo[rows]
            T = int(n[0])
            t = np.arange(T)[:, None]
            live = np.searchsorted(-n, -np.arange(T), side="left")
            inside = t < n
            x = flat[np.minimum(first + t, len(flat) - 1)].astype(np.intp)
            y = self._logits(x, live, "f")
            # The way back reads a stretch from its end; its labels are turned round.
            back, col = np.where(inside, n - 1 - t, 0), np.arange(len(rows))
            z = self._logits(x[back, col], live, "b")
            y += z[::-1] if inside.all() else np.take_along_axis(z, back[:, None, :], axis=0)
            y += self.net.p["bias"][:, None]
            y -= y.max(1, keepdims=True)
            np.exp(y, out=y)
            y /= y.sum(1, keepdims=True)
            mine = inside & (t >= at[rows] - lo[rows]) & (t < np.minimum(at[rows] + CORE, size[doc[rows]]) - lo[rows])
            best, top = np.zeros((T, len(rows)), np.intp), y[:, 0].copy()
            for q in range(1, c):
                best[y[:, q] > top] = q
                np.maximum(top, y[:, q], out=top)
            for q in range(c):
                np.add.at(out[:, q], doc[rows], np.where(mine, y[:, q], 0).sum(0, dtype=np.float64))
                np.add.at(out[:, c + q], doc[rows], (mine & (best == q)).sum(0))
        out[:, :c] /= np.maximum(size, 1)[:, None]
        return out


def sampled_docs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """(id, text, lang): a bounded sample of documents of each language, by hash order of their ids.

    Ids are ranked without texts: those whose hash is among the least, some more
    than ``per_lang`` of a language however many it has; then the texts of those
    picked are looked up, null ones left out. Rows that repeat an id are one place
    in the order.
    """
    d = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    d = d.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = stored(d.groupBy(F.col("lang").alias("lang2")).agg(F.count("*").alias("rows")), "languages")
    if counts.count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)
    place = F.xxhash64("id").bitwiseAND(F.lit(2**52 - 1)) / F.lit(2.0**52)
    near = d.select("id", "lang").withColumn("place", place).join(counts, F.col("lang") == F.col("lang2")).filter(F.col("place") < (2 * per_lang + 100) / F.col("rows"))
    order = Window.partitionBy("lang").orderBy("place", "id")
    picked = near.select("id", "lang", "place").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang).select(F.col("id").alias("id2"), F.col("lang").alias("lang2"))
    # picked has per_lang rows a language at the most.
    return d.filter("text IS NOT NULL").join(F.broadcast(picked), (F.col("id") == F.col("id2")) & (F.col("lang") == F.col("lang2")), "left_semi")


def training_stretches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_DOCS, per_doc: int = SAMPLE_STRETCHES) -> DataFrame:
    """(stretch, lang): stretches of LEARN bytes drawn from all of a text, from a bounded sample of documents of each language."""

    def run(batches):
        for batch in batches:
            found, langs = [], []
            for i, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                n = -(-len(data) // LEARN)
                picked = sorted(np.random.default_rng(zlib.crc32(str(i).encode())).choice(n, per_doc, replace=False)) if n > per_doc else range(n)
                found += [data[k * LEARN : (k + 1) * LEARN] for k in picked]
                langs += [lang] * len(picked)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(langs, pa.string())], names=["stretch", "lang"])

    d = sampled_docs(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_lang=per_lang)
    return d.select("id", "text", "lang").mapInArrow(trimmed(run), "stretch binary, lang string")


def train(docs: DataFrame, *, hidden: int = HIDDEN, epochs: int = EPOCHS, per_net: int = LEARNT, **columns) -> BiGRU | None:
    """The network for the languages of docs, from ``per_net`` stretches of each at the most, drawn from the bounded sample; None if that is empty."""
    rows = sorted((r["lang"], bytes(r["stretch"])) for r in training_stretches(docs, **columns).toLocalIterator())
    if not rows:
        return None
    classes = sorted({lang for lang, _ in rows})
    place = {c: i for i, c in enumerate(classes)}
    # Languages weigh alike: stretches of those with few are drawn again.
    by = defaultdict(list)
    for lang, w in rows:
        by[lang].append(w)
    rng = np.random.default_rng(3)
    size = min(per_net, max(map(len, by.values())))
    found, labels = [], []
    for lang, ws in by.items():
        found += [ws[k] for k in rng.choice(len(ws), size, replace=len(ws) < size)]
        labels += [place[lang]] * size
    return BiGRU(classes, hidden).fit(found, np.array(labels), epochs)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, net: BiGRU | None, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, lang_pred, score, and label_counts: how many bytes got each language, one row per row of docs.

    Every byte of the whole text is labelled; the score is the mean probability of
    the language that has the highest. Ties go to the first language by name.
    Null, empty and letterless texts are ``und`` with score 0, as are all texts if
    nothing could be learned. Repeated rows repeat their results and an empty table
    gives none. Other columns, whatever their names, are not read, but for those of
    ``carry``, which go along as the struct ``carried``.
    """
    d, more, carried = with_carried(docs, id_col, text_col, carry)
    names = [id_col, "lang_pred", "score", "label_counts", *(["carried"] if carry else [])]

    def run(batches):
        labeller = Labeller(net) if net else None
        for batch in batches:
            for part in slices(batch, 1):
                ts = [t if has_letter(t) else "" for t in texts(part, 1)]
                if labeller is None:
                    ts, pooled, c = [""] * len(ts), None, 0
                else:
                    pooled, c = labeller.pooled(ts), len(net.classes)
                best = pooled[:, :c].argmax(1) if c else None
                lang = [net.classes[best[i]] if t else UNDETERMINED for i, t in enumerate(ts)]
                score = [round(min(1.0, float(pooled[i, best[i]])), 6) if t else 0.0 for i, t in enumerate(ts)]
                counts = [list(zip(net.classes, pooled[i, c:].astype(int).tolist(), strict=True)) if t else [] for i, t in enumerate(ts)]
                along = [carried_of(part, id_col, text_col, carry, more)] if carry else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(counts, pa.map_(pa.string(), pa.int64())), *along], names=names)

    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, lang_pred string, score double, label_counts map<string,bigint>{carried}")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.filter(fold_of("doc_id") != 1))
    return identify(docs, net).select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "lang_pred", "score")
