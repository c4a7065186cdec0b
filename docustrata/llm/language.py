"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs of HIDDEN units read the UTF-8 bytes of a text, one forwards and one
backwards; at every byte both states give a distribution over the languages, so
that each position is labelled. A document's probabilities are the means over
its positions that belong to letters. Texts are read in windows of WINDOW bytes,
whole texts whatever their length; states start at zero in each window, which
lets windows of all documents run side by side as matrix products.

The network is trained in numpy by backpropagation through time with Adam, on
windows drawn from all over the whole texts of SAMPLE documents of each language at
most; the windows are drawn on the executors, DRAWN of a document and MOST in all,
so that the driver's share is bounded. All languages are learned; more than
MOST_LABELS are an error. Documents that are held out take no part. A prediction
sees the text alone. Scoring is one pass over the table, without a shuffle.

Null texts and texts without a letter are `und` with score 0, and so is
everything if there was nothing to learn from. Extra columns and repeated rows
are kept as they are, but columns named as the results are refused with an error;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docustrata.llm.common import discard, fresh_names, held_out
from docustrata.llm.sampling import labelled_sample, sampling_rates
from docustrata.llm.tokens import chunks, release

HIDDEN, WINDOW, SAMPLE, MOST_LABELS = 8, 128, 1500, 1000
#: Bytes of a window that is learned from; windows of a document, and of all.
LEARNED, DRAWN, MOST = 64, 32, 400_000
UNKNOWN = "und"
#: Windows that run side by side.
ABREAST = 2048
#: Bytes that are not part of a letter: the ASCII ones that are no letters.
LETTER = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows of all texts, and the text that each is from."""
    sizes = np.array([len(t) for t in texts], dtype="int64")
    n = -(-sizes // width)
    flat = np.frombuffer(b"".join(texts), dtype="uint8")
    out = np.zeros(int(n.sum()) * width, dtype="uint8")
    shift = (np.cumsum(n) - n) * width - (np.cumsum(sizes) - sizes)
    out[np.arange(len(flat)) + np.repeat(shift, sizes)] = flat
    return out.reshape(-1, width), np.repeat(np.arange(len(texts)), n)


@dataclass
class Network:
    """Per direction: x (256 x H) and u (H x H) for the gates z, r and the candidate n; o (H x C). Bias: of r's product b, of the output c."""

    labels: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {"c": np.zeros(len(labels))}
        for d in "fb":
            for g in "zrn":
                p[f"{d}x{g}"] = rng.normal(0, 0.3, (256, hidden))
                p[f"{d}u{g}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, hidden))
            p[f"{d}b"], p[f"{d}o"] = np.zeros(hidden), rng.normal(0, 0.3, (hidden, len(labels)))
        return cls(labels, {k: v.astype("float32") for k, v in p.items()})

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        """Per window: sums over its letter positions of the position's probabilities, and in the last column their number."""
        out = np.empty((len(w), len(self.labels) + 1), dtype="float64")
        for i in range(0, len(w), ABREAST):
            out[i : i + ABREAST] = self._block(np.ascontiguousarray(w[i : i + ABREAST].T))
        return out

    def _block(self, x: np.ndarray) -> np.ndarray:
        """x: (time, windows). Gates use tanh alone: sigmoid(a) = (1 + tanh(a / 2)) / 2, the halves folded into the weights."""
        p, (steps, n), hidden = self.p, x.shape, len(self.p["fb"])
        logits = np.empty((steps, n, len(self.labels)), dtype="float32")
        logits[:] = p["c"]
        z, r, c, u, a = (np.empty((n, hidden), dtype="float32") for _ in range(5))
        for d in "fb":
            xz, uz, xr, ur, xn, un, b = p[d + "xz"] / 2, p[d + "uz"] / 2, p[d + "xr"] / 2, p[d + "ur"] / 2, p[d + "xn"], p[d + "un"] / 2, p[d + "b"] / 2
            h, o = np.zeros((n, hidden), dtype="float32"), p[d + "o"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                at = x[t]
                np.take(xz, at, axis=0, out=z, mode="clip")
                z += np.dot(h, uz, out=a)
                np.tanh(z, out=z)
                np.take(xr, at, axis=0, out=r, mode="clip")
                r += np.dot(h, ur, out=a)
                np.tanh(r, out=r)
                np.dot(h, un, out=u)
                u += b
                np.take(xn, at, axis=0, out=c, mode="clip")
                c += u
                r *= u
                c += r
                np.tanh(c, out=c)
                h -= c
                z += 1
                z *= 0.5
                h *= z
                h += c
                logits[t] += h @ o
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        letters = LETTER[x]
        logits *= letters[:, :, None]
        return np.concatenate([logits.sum(0, dtype="float64"), letters.sum(0)[:, None]], axis=1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows x (windows x time) with labels y over letter positions, and its gradients through time."""
        p, x, hidden = self.p, x.T, len(self.p["fb"])
        steps, n = x.shape
        logits, kept = np.zeros((steps, n, len(self.labels)), dtype="float32") + p["c"], {}
        sig = lambda a: 1 / (1 + np.exp(-a))
        for d in "fb":
            h, rows = np.zeros((n, hidden), dtype="float32"), [None] * steps
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = sig(p[d + "xz"][x[t]] + h @ p[d + "uz"])
                r = sig(p[d + "xr"][x[t]] + h @ p[d + "ur"])
                u = h @ p[d + "un"] + p[d + "b"]
                c = np.tanh(p[d + "xn"][x[t]] + r * u)
                rows[t] = (h, z, r, u, c)
                h = c + z * (h - c)
                logits[t] += h @ p[d + "o"]
                rows[t] += (h,)
            kept[d] = rows
        e = np.exp(logits - logits.max(2, keepdims=True))
        q = e / e.sum(2, keepdims=True)
        m = LETTER[x].astype("float32")
        total = max(1.0, float(m.sum()))
        loss = float(-(np.log(q[:, np.arange(n), y] + 1e-9) * m).sum() / total)
        q[:, np.arange(n), y] -= 1
        dl = q * (m / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"] = dl.sum((0, 1))
        for d in "fb":
            back, das = np.zeros((n, hidden), dtype="float32"), {k: np.zeros((steps, n, hidden), dtype="float32") for k in "zrn"}
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, u, c, new = kept[d][t]
                g[d + "o"] += new.T @ dl[t]
                dh = back + dl[t] @ p[d + "o"].T
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                du = dc * r
                back = dh * z + dz @ p[d + "uz"].T + dr @ p[d + "ur"].T + du @ p[d + "un"].T
                g[d + "uz"] += h.T @ dz
                g[d + "ur"] += h.T @ dr
                g[d + "un"] += h.T @ du
                g[d + "b"] += du.sum(0)
                das["z"][t], das["r"][t], das["n"][t] = dz, dr, dc
            for k in "zrn":
                np.add.at(g[f"{d}x{k}"], x.reshape(-1), das[k].reshape(-1, hidden))
        return loss, g


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, width: int = LEARNED, batch: int = 256, steps: int = 300, rate: float = 0.03, seed: int = 1) -> Network:
    """Batches hold each language equally often."""
    names = sorted(set(labels))
    net, rng = Network.fresh(names, hidden, seed), np.random.default_rng(seed)
    w, of = windows(texts, width)
    y = np.array([names.index(x) for x in labels])[of]
    w, y = w[LETTER[w].any(1)], y[LETTER[w].any(1)]
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    means, squares = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    by = [b for b in by if len(b)]
    for step in range(1, steps + 1 if len(by) > 1 else 1):
        pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])
        _, g = net.gradients(w[pick], y[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, 5 / (norm + 1e-9)) * (1 - (step - 1) / steps)
        for k, v in g.items():
            means[k] = 0.9 * means[k] + 0.1 * v
            squares[k] = 0.999 * squares[k] + 0.001 * v * v
            net.p[k] = (net.p[k] - now * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)).astype("float32")
    return net


def drawn(text: bytes, most: int, width: int = LEARNED) -> bytes:
    """Up to `most` windows of a text, in order, drawn from all of it by a seed of its own."""
    n = -(-len(text) // width)
    if n <= most:
        return text
    pick = np.sort(np.random.default_rng(zlib.crc32(text)).choice(n - 1, most, replace=False))  # but the last, which may be shorter
    return b"".join(text[k * width : (k + 1) * width] for k in pick.tolist())


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """From rows of docs with a language that are not held out."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    one = rows.groupBy(key).agg(F.min(lang).alias("y"))
    rates = sampling_rates(one, key, "y", sample, MOST_LABELS)
    chosen = labelled_sample(rows, one, key, text, "y", sample, rates)
    each = max(1, min(DRAWN, MOST // max(1, chosen.count())))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([drawn(t.encode(), each) for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["key", "windows", "label"])

    kind = chosen.schema["key"].dataType.simpleString()
    data = chosen.select("key", "text", F.col("label").cast("string")).mapInArrow(draw, f"key {kind}, windows binary, label string").orderBy("key").collect()
    discard(chosen)
    return train([bytes(r["windows"]) for r in data], [r["label"] for r in data]) if data else None


def identify(docs: DataFrame, network: Network | None, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns name and score."""
    fresh_names(docs, name, score)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        net = sent.value
        for b in chunks(batches, at):
            texts = pc.fill_null(b.column(at).cast(pa.large_string()), "")
            named = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            label, value = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            if net is not None and named.any():
                w, of = windows([t.encode() if ok else b"" for t, ok in zip(texts.to_pylist(), named, strict=True)])
                sums = net.probabilities(w)
                per = np.stack([np.bincount(of, sums[:, k], b.num_rows) for k in range(sums.shape[1])], axis=1)
                per = per[:, :-1] / np.maximum(per[:, -1:], 1)
                label[named] = np.array(net.labels, dtype=object)[per[named].argmax(1)]
                value[named] = np.clip(per[named].max(1), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.string()), pa.array(value)], names=[*b.schema.names, name, score])

    return docs.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
