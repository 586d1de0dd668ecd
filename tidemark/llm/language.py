"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the bytes of the whole text, over words and lines, in both directions and labels every
byte; it is trained by backpropagation through time. A document's probabilities are the mean of those at all
its letters' bytes. Long texts are read in stretches of OWN bytes side by side; each direction begins CONTEXT
bytes outside its stretch, so every byte is labelled with at least that much text before and after it.

Stretches fill blocks of one fixed shape, so a stretch's sums don't depend on what else is in its batch, and
a document's score not on how rows are partitioned. The network is fitted on a bounded sample of labelled
documents: STRETCHES, from anywhere in the text, of each of DOCS documents a language, both chosen by hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import slices

HIDDEN = 16
#: Bytes of a stretch that are labelled, and bytes read before and after it: of texts, and in training.
OWN, CONTEXT = 224, 24
TRAIN_OWN, TRAIN_CONTEXT = 48, 16
#: Stretches computed together: few enough that a step's arrays stay in the cache.
ROWS = 512
DOCS, STRETCHES = 300, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01

_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1.0


def stretches(texts: list[bytes], own: int = OWN, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Rows of context, own and context bytes that cover all texts, with zeros outside of a text, and whose text each is."""
    counts = np.array([-(-len(t) // own) for t in texts], np.int64)
    gap = own + 2 * context
    joined = np.frombuffer(bytes(context) + b"".join(t + bytes(gap - len(t) % own) for t in texts) + bytes(gap), np.uint8)
    sizes = np.array([len(t) + gap - len(t) % own for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), counts)
    at = starts[owner] + own * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    return np.lib.stride_tricks.sliding_window_view(joined, gap)[at], owner


def _tanh_sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Network:
    """For each direction: a table of inputs by byte, recurrent weights and biases; then one linear layer.

    Both directions are computed side by side, as the first axis of the weights; the second reads the
    rows from their ends.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = {
            "x": draw(2, 256, 3 * hidden, scale=0.3),
            "u": draw(2, hidden, 3 * hidden, scale=hidden**-0.5),
            "v": np.zeros((2, 1, 3 * hidden), np.float32),
            "o": draw(2 * hidden, len(labels), scale=0.3),
            "c": np.zeros(len(labels), np.float32),
        }

    def _states(self, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States at each byte, of both directions: time, row, unit."""
        k, u, v = self.hidden, self.w["u"], self.w["v"]
        table = (self.w["x"] + v).reshape(512, 3 * k)  # the bias of the inner part is added with the input, outside of the reset gate
        n, length = rows.shape
        codes = np.stack([rows.T, rows.T[::-1] + np.int64(256)], axis=1)  # time, direction, row
        h = np.zeros((2, n, k), table.dtype)
        out = np.empty((length, n, 2 * k), table.dtype)
        for t in range(length):
            x, g = table[codes[t]], np.matmul(h, u)
            zr = _tanh_sigmoid(x[..., : 2 * k] + g[..., : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            inner = g[..., 2 * k :]
            new = np.tanh(x[..., 2 * k :] + r * inner)
            if keep is not None:
                keep.append((h, z, r, new, inner))
            h = new + z * (h - new)
            out[t, :, :k] = h[0]
            out[length - 1 - t, :, k:] = h[1]
        return out

    def read(self, rows: np.ndarray, own: slice) -> np.ndarray:
        """Each label's probability at the bytes within ``own``: label, time, row.

        As ``_states``, for reading only, in place and with the gates side by side: with e = exp(-x) a gate is 1 / (1 + e), so what it
        weighs is divided by 1 + e, and tanh(x) is 1 - 2 / (1 + exp(2 x)); the signs and the two are in the weights. An e that is
        infinite gives the limit.
        """
        k, (n, length) = self.hidden, rows.shape
        scale = np.array([-1, -1, 2], self.w["u"].dtype)
        gates = lambda x: np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], 3, k) * scale[:, None], -2, 0))
        weights, table = gates(self.w["u"]), gates(self.w["x"] + self.w["v"]).reshape(3 * 512, k)
        codes = np.stack([rows.T, rows.T[::-1] + np.int64(256)], axis=1)
        codes = np.ascontiguousarray(codes[:, None] + 512 * np.arange(3)[:, None, None])  # time, gate, direction, row
        h, gap, x, g = (np.zeros((*m, 2, n, k), table.dtype) for m in ((), (), (3,), (3,)))
        both, new, x_both, x_new = g[:2], g[2], x[:2], x[2]
        size = own.stop - own.start
        out = np.empty((2, size, n, k), table.dtype)
        with np.errstate(over="ignore"):
            for t in range(max(own.stop, length - own.start)):  # what follows is after the bytes of both directions
                np.take(table, codes[t], axis=0, out=x, mode="clip")
                np.matmul(h, weights, out=g)
                both += x_both
                np.exp(both, out=both)
                both += 1.0
                new /= both[1]
                new += x_new
                np.exp(new, out=new)
                new += 1.0
                np.divide(-2.0, new, out=new)
                new += 1.0
                np.subtract(h, new, out=gap)
                gap /= both[0]
                np.add(new, gap, out=h)
                if own.start <= t < own.stop:
                    out[0, t - own.start] = h[0]
                if own.start <= length - 1 - t < own.stop:
                    out[1, length - 1 - t - own.start] = h[1]
        logits = self.w["o"][:k].T @ out[0].reshape(-1, k).T + self.w["o"][k:].T @ out[1].reshape(-1, k).T + self.w["c"][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, size, n)

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.w["o"] + self.w["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, rows: np.ndarray, labels: np.ndarray, own: slice = slice(None)) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy over the letters' bytes within ``own`` and its gradients, by backpropagation through time."""
        kept: list = []
        states = self._states(rows, kept)
        p = self._probabilities(states)
        weight = np.zeros(rows.T.shape, np.float32)
        weight[own] = _LETTER[rows.T[own]]
        total, who, k = max(float(weight.sum()), 1.0), np.arange(len(rows)), self.hidden
        loss = float(-(np.log(p[:, who, labels] + 1e-30) * weight).sum() / total)
        dlogits = p * weight[..., None] / total
        dlogits[:, who, labels] -= weight / total
        grads = {"o": np.einsum("tni,tnk->ik", states, dlogits), "c": dlogits.sum(axis=(0, 1))}
        dstates = dlogits @ self.w["o"].T
        out = np.stack([dstates[..., :k], dstates[::-1, :, k:]], axis=1)  # time, direction, row, unit
        u, dh = self.w["u"], np.zeros(out.shape[1:], out.dtype)
        du, inputs = np.zeros_like(u), np.empty((len(kept), 2, len(rows), 3 * k), out.dtype)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, new, inner = kept[t]
            dh = dh + out[t]
            dn = dh * (1 - z) * (1 - new * new)
            da = inputs[t]
            da[..., :k] = dh * (h - new) * z * (1 - z)
            da[..., k : 2 * k] = dn * inner * r * (1 - r)
            da[..., 2 * k :] = dn
            dg = da.copy()
            dg[..., 2 * k :] *= r
            du += np.matmul(h.transpose(0, 2, 1), dg)
            dh = dh * z + np.matmul(dg, u.transpose(0, 2, 1))
        codes = np.stack([rows.T, rows.T[::-1] + np.int64(256)], axis=1).ravel()
        order = np.argsort(codes, kind="stable")
        there, first = np.unique(codes[order], return_index=True)
        dx = np.zeros((512, 3 * k), out.dtype)
        dx[there] = np.add.reduceat(inputs.reshape(-1, 3 * k)[order], first, axis=0)
        dx = dx.reshape(2, 256, 3 * k)
        return loss, grads | {"x": dx, "u": du, "v": dx.sum(axis=1, keepdims=True)}

    def fit(self, rows: np.ndarray, labels: np.ndarray, own: slice, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over batches of rows in random order; returns each epoch's mean loss."""
        rng = np.random.Generator(np.random.PCG64(seed))
        losses, step = [], 0
        m, s = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            parts = np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch))
            total, now = 0.0, rate * (1 - epoch / epochs)
            for at in parts:
                loss, grads = self.gradients(rows[at], labels[at], own)
                total += loss
                step += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.99 * s[name] + 0.01 * g * g
                    self.w[name] = (self.w[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(parts))
        return losses

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """By text, the sums over its letters' bytes of each label's probability, and their number."""
        out = np.zeros((len(texts), len(self.labels) + 1))
        rows, owner = stretches(texts)
        own = slice(CONTEXT, CONTEXT + OWN)
        for i in range(0, len(rows), ROWS):
            block = np.zeros((ROWS, rows.shape[1]), np.uint8)
            n = len(rows[i : i + ROWS])
            block[:n] = rows[i : i + ROWS]
            weight = _LETTER[block.T[own]]
            found = np.concatenate([(self.read(block, own) * weight).sum(axis=1), weight.sum(axis=0)[None]]).T[:n]
            np.add.at(out, owner[i : i + n], found.astype(np.float64))
        return out


def held_out(doc_id: Column, of: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text leaves this remainder; no id leaves none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def chosen_stretches(text: bytes, most: int = STRETCHES) -> np.ndarray:
    """``most`` stretches with letters, for training, from anywhere in the whole text: of an order that the text alone decides."""
    own = stretches([text], TRAIN_OWN, TRAIN_CONTEXT)[0]
    own = own[_LETTER[own[:, TRAIN_CONTEXT : TRAIN_CONTEXT + TRAIN_OWN]].any(axis=1)]
    return own[np.random.Generator(np.random.PCG64(zlib.crc32(text))).permutation(len(own))[:most]]


def sample(docs: DataFrame, most: int = DOCS, stretches_each: int = STRETCHES) -> list[tuple[str, bytes]]:
    """(lang, stretch) of ``most`` documents a language at most, those of the least hashes, in a fixed order; no text comes to the driver."""
    ids = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    counts = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    spread, draw = 1 << 30, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Enough hashes for ``most`` of each language, and some more: then the least are taken.
    below = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(spread, int(spread * (most + 6 * most**0.5 + 10) / n)))])
    found = sorted((r.lang, r.draw, r.doc_id) for r in ids.where(draw < below[F.col("lang")]).select("lang", draw.alias("draw"), "doc_id").distinct().collect())
    chosen, seen = [], dict.fromkeys(counts, 0)
    for lang, _, doc in found:
        seen[lang] += 1
        if seen[lang] <= most:
            chosen.append(doc)
    rows = docs.where(F.col("doc_id").isin(chosen) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Of a repeated id one row.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", F.col("text").cast("string").alias("text"))).alias("r")).select("r.lang", "r.text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, x.tobytes()) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in chosen_stretches(text.encode(), stretches_each)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["lang", "stretch"])

    return sorted((r.lang, bytes(r.stretch)) for r in rows.mapInArrow(cut, "lang string, stretch binary").collect())


def train(rows: list[tuple[str, bytes]]) -> Network | None:
    """A network from (lang, stretch); None if there is nothing to learn from."""
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    network = Network(labels)
    network.fit(np.stack([np.frombuffer(x, np.uint8) for _, x in rows]), np.array([labels.index(lang) for lang, _ in rows]), slice(TRAIN_CONTEXT, TRAIN_CONTEXT + TRAIN_OWN))
    return network


#: Bytes of texts whose stretches are laid out at a time, unless one text is longer.
_TOGETHER = 1 << 20


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs(doc_id, text)``, from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Repeated rows are each
    judged alike; other columns are not looked at. Of equal probabilities the label first in order is taken.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if network is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x or "" for x in part.column("text").to_pylist()]
                raw = [x.encode() for x in texts]
                total = np.concatenate([network.sums(raw[i:j]) for i, j in slices(raw, _TOGETHER)])
                mean = np.minimum(total[:, :-1] / np.maximum(total[:, -1:], 1), 1.0)
                best = mean.argmax(axis=1)
                known = [bool(n) and any(map(str.isalpha, x)) for n, x in zip(total[:, -1], texts, strict=True)]
                found = [network.labels[b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, mean[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
