"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte; a document's probabilities are the mean over its
bytes. It is trained in numpy by backpropagation through time on windows drawn
from a bounded sample of labelled documents. Long texts are read in windows that
overlap by a few bytes, so that every byte is labelled with bytes on both sides
and the work grows with the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

HIDDEN = 8
#: Bytes labelled in a window, and bytes read before and after them.
CORE, EDGE = 480, 16
#: Places whose probabilities are held at a time.
STRIP = 16
#: Bound of the labelled sample: documents, windows of each, bytes of a window.
SAMPLE, WINDOWS, SPAN = 3000, 4, 96
_LETTER = regex.compile(r"\p{L}").search


class Network:
    """Two GRUs (forward and backward, stacked on the first axis) and a softmax over languages."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
            "u": rng.normal(0, 0.35, (2, h, 3 * h)).astype(np.float32),
            "v": rng.normal(0, 0.3, (2 * h, max(1, len(languages)))).astype(np.float32),
            "c": np.zeros(max(1, len(languages)), np.float32),
        }

    def states(self, text: np.ndarray, lengths: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, T, B, H) for bytes (T, B); rows end at ``lengths``. The backward states are in text order."""
        t, b = text.shape
        h, x, u = HIDDEN, self.p["x"], self.p["u"]
        out = np.empty((2, t, b, h), np.float32)
        now = np.zeros((2, b, h), np.float32)
        short = lengths is not None and lengths.min() < t
        for i in range(t):
            a = np.stack((x[0].take(text[i], axis=0), x[1].take(text[t - 1 - i], axis=0)))
            g = now @ u
            # the sigmoid is taken as a tanh of half its argument
            zr = a[..., : 2 * h] + g[..., : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :h], zr[..., h:]
            gn = g[..., 2 * h :]
            n = np.tanh(a[..., 2 * h :] + r * gn)
            if keep is not None:
                keep.append((now, z, r, gn, n))
            now = n + z * (now - n)
            if short:
                now[1] *= (t - 1 - i < lengths)[:, None]
            out[0, i] = now[0]
            out[1, t - 1 - i] = now[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Softmax at each position: (T, B, languages)."""
        h = HIDDEN
        y = states[0] @ self.p["v"][:h] + states[1] @ self.p["v"][h:] + self.p["c"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def gradients(self, text: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of every position, by backpropagation through time."""
        t, b = text.shape
        h, u = HIDDEN, self.p["u"]
        steps: list = []
        s = self.states(text, keep=steps)
        dy = self.probabilities(s)
        dy[:, np.arange(b), label] -= 1
        dy /= t * b
        flat = dy.reshape(t * b, -1)
        g = {"v": np.concatenate([s[k].reshape(t * b, h).T @ flat for k in (0, 1)]), "c": flat.sum(0), "u": np.zeros_like(u)}
        back = np.stack([dy @ self.p["v"][:h].T, dy @ self.p["v"][h:].T])
        inputs = np.empty((2, t, b, 3 * h), np.float32)
        carry = np.zeros((2, b, h), np.float32)
        for i in range(t - 1, -1, -1):
            before, z, r, gn, n = steps[i]
            d = carry + np.stack((back[0, i], back[1, t - 1 - i]))
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            rec = np.concatenate((dz, dr, dn * r), axis=-1)
            g["u"] += before.transpose(0, 2, 1) @ rec
            carry = d * z + rec @ u.transpose(0, 2, 1)
            own = np.concatenate((dz, dr, dn), axis=-1)
            inputs[0, i], inputs[1, t - 1 - i] = own[0], own[1]
        g["x"] = np.zeros_like(self.p["x"])
        order = np.argsort(text.ravel(), kind="stable")
        codes = text.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        for k in (0, 1):
            g["x"][k, codes[first]] = np.add.reduceat(inputs[k].reshape(t * b, -1)[order], first, axis=0)
        return g

    def train(self, text: np.ndarray, label: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over windows ``text`` (windows, bytes); languages are drawn evenly."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            which = rng.integers(0, len(by), batch)
            rows = np.array([by[k][rng.integers(0, len(by[k]))] for k in which])
            g = self.gradients(np.ascontiguousarray(text[rows].T), label[rows])
            norm = float(np.sqrt(sum((w * w).sum() for w in g.values())))
            for k, w in g.items():
                w = w * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (w - m[k])
                v[k] += 0.01 * (w * w - v[k])
                self.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def documents(self, texts: list[bytes], batch: int = 1024) -> np.ndarray:
        """Mean probabilities over all bytes of each text: (texts, languages)."""
        parts = [(k, at, min(at + CORE, len(t))) for k, t in enumerate(texts) for at in range(0, len(t), CORE)]
        cut = [(k, max(0, a - EDGE), min(len(texts[k]), e + EDGE), a, e) for k, a, e in parts]
        cut.sort(key=lambda c: c[2] - c[1])
        total = np.zeros((len(texts), len(self.p["c"])))
        for at in range(0, len(cut), batch):
            own = cut[at : at + batch]
            n = np.array([e - s for _, s, e, _, _ in own])
            grid = np.zeros((len(own), int(n.max())), np.uint8)
            for row, (k, s, e, _, _) in zip(grid, own):
                row[: e - s] = np.frombuffer(texts[k], np.uint8, e - s, s)
            states = self.states(np.ascontiguousarray(grid.T), n)
            first, last = (np.array(c) for c in zip(*((a - s, e - s) for _, s, _, a, e in own)))
            sums = np.zeros((len(own), total.shape[1]))
            # of few places at a time, as probabilities and what they are made of take several times the states
            for low in range(0, states.shape[1], STRIP):
                for place, p in enumerate(self.probabilities(states[:, low : low + STRIP]), low):
                    sums += p * ((place >= first) & (place < last))[:, None]
            np.add.at(total, [k for k, *_ in own], sums)
        return total / np.maximum(1, [len(t) for t in texts])[:, None]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("windows", pa.list_(pa.binary()))])
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part, windows = batch.slice(first, 512), []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(doc & 0xFFFFFFFF)
                places = [int(rng.integers(0, max(1, len(raw) - SPAN + 1))) for _ in range(WINDOWS if len(raw) > SPAN else 1)]
                windows.append([(raw[at : at + SPAN] * SPAN)[:SPAN] for at in places])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(windows, pa.list_(pa.binary()))], schema=schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network:
    """A network trained on at most ``sample`` rows with a label and a letter, drawn by hash of the id (repeated ids: by their windows); windows come from anywhere in them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    drawn = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    made = rows.join(F.broadcast(drawn), "doc_id", "left_semi").select("doc_id", "text", "lang").mapInArrow(_windows, "doc_id long, lang string, windows array<binary>")
    # ids may repeat, so rows are bounded as well
    chosen = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("windows"), "lang").limit(sample)
    found = chosen.select("lang", F.explode("windows").alias("bytes")).collect()
    found.sort(key=lambda r: (r.lang, bytes(r.bytes)))
    languages = sorted({r.lang for r in found})
    net = Network(languages)
    if len(languages) > 1:
        net.train(np.array([np.frombuffer(r.bytes, np.uint8) for r in found]), np.array([languages.index(r.lang) for r in found]))
    return net


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` and the ``carry`` columns of each row; ``und`` with score 0 where the text is null or has no letter, or nothing was learned."""
    carry = carry or []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_body"), *(F.col(c) for c in carry))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size
    kept = [f for f in rows.schema if f.name != "_body"]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                some = [k for k, t in enumerate(texts) if t is not None and _LETTER(t)] if net.languages else []
                if some:
                    p = net.documents([texts[k].encode("utf-8", "surrogatepass") for k in some])
                    for k, best, q in zip(some, p.argmax(axis=1), p.max(axis=1)):
                        lang[k], score[k] = net.languages[best], min(1.0, float(q))
                columns = [part.column(i) for i, f in enumerate(part.schema) if f.name != "_body"]
                names = [f.name for f in part.schema if f.name != "_body"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])
            trim()

    return rows.mapInArrow(run, out_schema)
