"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.html_blocks import Block, Element, blocks
from joblode.llm.html_pages import labelled_pages

#: Labelled pages that the model is trained on.
TRAINING_PAGES = 1200


def near_features(inside: Element | None) -> list[str]:
    """Features of a block's two innermost elements, beside those that each element of its path adds."""
    if inside is None:
        return ["b:"]
    up = inside.parent
    return [f"b:{inside.tag}", f"t0:{inside.tag}", *([f"t1:{up.tag}"] if up else [])]


def path_features(inside: Element | None) -> list[str]:
    """All features of a block's ancestors."""
    out = near_features(inside)
    while inside is not None:
        out += inside.new
        inside = inside.parent
    return out


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    density = b.linked / len(b.text)
    return [f"w:{min(7, words.bit_length())}", f"l:{round(density * 4)}", f"e:{b.text[-1] in '.!?:;…»”'}", f"s:{b.text[0] in '©&|»«'}", f"d:{min(3, sum(b.text.count(x) for x in '.!?'))}", "one"]


class Model:
    """Weights of the main label's features, and scores of the four transitions."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], start: list[float]):
        self.weights, self.steps, self.start = weights, steps, start

    def path_score(self, inside: Element | None) -> float:
        """Sum of the weights that the elements of a path add; each element keeps its own, so each is visited once."""
        chain = []
        while inside is not None and inside.score is None:
            chain.append(inside)
            inside = inside.parent
        score = 0.0 if inside is None else inside.score
        for e in reversed(chain):
            score = e.score = score + sum(self.weights.get(f, 0.0) for f in e.new)
        return score

    def unary(self, b: Block) -> float:
        return self.path_score(b.inside) + sum(self.weights.get(f, 0.0) for f in (*near_features(b.inside), *text_features(b)))

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (1: main) of a page's blocks."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.steps
        back: list[tuple[int, int]] = []
        a, b = self.start[0], self.start[1] + self.unary(page[0])
        for block in page[1:]:
            u = self.unary(block)
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + u
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def text(self, html: str | None) -> str:
        page = blocks(html or "")
        return "\n\n".join(b.text for b, y in zip(page, self.decode(page), strict=True) if y)


def train(pages: list[str], rounds: int = 150, ridge: float = 2e-3) -> Model:
    """Maximum likelihood (forward-backward gradients, Adam) on pages whose main blocks carry data-main."""
    parsed = [p for p in map(blocks, pages) if p]
    index: dict[str, int] = {}
    at, col = [], []
    length = max(map(len, parsed))
    y, real = np.zeros((len(parsed), length), int), np.zeros((len(parsed), length), bool)
    for i, page in enumerate(parsed):
        for t, b in enumerate(page):
            real[i, t], y[i, t] = True, b.main
            for f in [*path_features(b.inside), *text_features(b)]:
                at.append(i * length + t)
                col.append(index.setdefault(f, len(index)))
    at, col = np.array(at), np.array(col)
    w = np.zeros(len(index) + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    ends = real.sum(1) - 1
    rows = np.arange(len(parsed))
    pairs = real[:, 1:]
    for k in range(1, rounds + 1):
        u = np.zeros((len(parsed), length, 2))
        u[..., 1] = np.bincount(at, weights=w[col], minlength=y.size).reshape(y.shape)
        steps, start = w[-6:-2].reshape(2, 2), w[-2:]
        fwd, bwd = np.zeros_like(u), np.zeros_like(u)
        fwd[:, 0] = start + u[:, 0]
        for t in range(1, length):
            new = np.logaddexp(fwd[:, t - 1, :1] + steps[0], fwd[:, t - 1, 1:] + steps[1]) + u[:, t]
            fwd[:, t] = np.where(real[:, t, None], new, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = u[:, t + 1] + bwd[:, t + 1]
            new = np.logaddexp(steps[:, 0] + nxt[:, :1], steps[:, 1] + nxt[:, 1:])
            bwd[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = np.logaddexp(fwd[rows, ends, 0], fwd[rows, ends, 1])
        p = np.exp(fwd + bwd - z[:, None, None])
        g = np.zeros_like(w)
        g[: len(index)] = np.bincount(col, weights=((p[..., 1] - y) * real).ravel()[at], minlength=len(index))
        for i in (0, 1):
            for j in (0, 1):
                both = np.exp(fwd[:, :-1, i] + steps[i, j] + u[:, 1:, j] + bwd[:, 1:, j] - z[:, None])
                seen = (y[:, :-1] == i) & (y[:, 1:] == j)
                g[len(index) + 2 * i + j] = ((both - seen) * pairs).sum()
            g[len(index) + 4 + i] = (p[:, 0, i] - (y[:, 0] == i)).sum()
        g = g / len(parsed) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    if not math.isfinite(float(w.sum())):
        raise ArithmeticError("training diverged")
    return Model({f: float(w[i]) for f, i in index.items()}, w[-6:-2].reshape(2, 2).tolist(), w[-2:].tolist())


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = [model.text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    The blocks labelled main, in page order, joined by two line ends; character references are decoded and white
    space inside a block is one space. Null and empty pages, and pages without main blocks, give an empty text.
    Repeated rows repeat; nulls in page_id and url stay; an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages(TRAINING_PAGES)))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
