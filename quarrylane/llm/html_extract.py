"""Operator 12, the main text of web pages, by markup and by suffix arrays of hosts.

The markup says which blocks may be the article's (html_blocks). Then the token streams of a host's pages are
concatenated, and in their suffix array the substrings that many of its pages have are found: they are boilerplate, and
blocks that they cover go. Hosts of any size are served: a small host is one group, a large one is cut into shards. A
substring that a share of all pages has is as frequent in at least one shard, so that shards propose substrings, which
are then counted exactly over all of the host's pages. Only these few travel, not the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import table
from quarrylane.llm.html_blocks import Block, article_of, blocks_of
from quarrylane.llm.periodic_runs import suffix_array
from quarrylane.llm.spelling import step

#: The tokens (words and one for each block's border) of a repeated substring; a power of two.
WIDTH = 8
#: Of a host's pages, the fewest and the share that a substring is in if it is boilerplate: where no article is marked, and
#: within a marked one.
OFTEN, OFTEN_WITHIN = (3, 1 / 3), (4, 2 / 3)
#: Bytes of HTML of a shard; a host of no more is one group.
SHARD = 2 << 20
#: A large host's pages stay where they are if each task has so many of them; else they are brought together first.
DENSE = 4
#: The most rows that are broadcast; more are joined by a shuffle.
CARRIED = 1 << 20
_BORDER = 0


@dataclass
class Page:
    """A page's blocks that may be the article's, and whether the article is marked."""

    blocks: list[Block]
    marked: bool

    @classmethod
    def of(cls, html: str) -> Page:
        blocks, rank = article_of(blocks_of(html))
        return cls(blocks, rank > 0)


@dataclass
class Streams:
    """The token streams of pages, one after the other: tokens, where pages and where blocks begin, with an end each."""

    tokens: np.ndarray
    pages: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, pages: list[Page]) -> Streams:
        words, sizes, many = [], [], []
        for page in pages:
            for b in page.blocks:
                own = b.text.split(" ")
                words.append(None)
                words += own
                sizes.append(len(own) + 1)
            many.append(sum(sizes[len(sizes) - len(page.blocks) :]) if page.blocks else 0)
        coded = pa.array(words, pa.string()).dictionary_encode()
        names = np.array([xxhash.xxh64_intdigest(w) | 1 for w in coded.dictionary.to_pylist()] + [_BORDER], np.uint64)
        codes = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        return cls(names[codes] if len(codes) else np.zeros(0, np.uint64), np.append(0, np.cumsum(many)), np.append(0, np.cumsum(sizes)).astype(np.int64))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a substring of WIDTH tokens begins within its page, and its hash."""
        size = np.diff(self.pages)
        room = np.maximum(size - WIDTH + 1, 0)
        at = np.repeat(self.pages[:-1] - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
        h = np.full(len(at), np.uint64(WIDTH))
        for k in range(WIDTH):
            h = step(h, self.tokens[at + k])
        return at, h.view(np.int64)


def repeated(s: Streams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the substrings of WIDTH tokens, and how many of the pages have each: the LCP intervals of that depth."""
    at, h = s.windows()
    if not len(at):
        return h, np.zeros(0, np.int64)
    ids = np.unique(s.tokens, return_inverse=True)[1]
    order, _, lcp = suffix_array(ids, s.pages, apart=False, depth=WIDTH)
    interval = np.cumsum(lcp[:-1] < WIDTH) - 1  # of each suffix in order
    page = np.searchsorted(s.pages, order, "right") - 1
    whole = order + WIDTH <= s.pages[page + 1]
    pair = np.unique(interval[whole] * len(s.pages) + page[whole])
    of, many = np.unique(pair // len(s.pages), return_counts=True)
    place = np.zeros(len(s.tokens), np.int64)
    place[at] = np.arange(len(at))
    first = np.zeros(int(interval[-1]) + 1, np.int64)
    first[interval[whole]] = order[whole]
    return h[place[first[of]]], many


def needed(pages: int, often: tuple[int, float]) -> int:
    return max(often[0], int(np.ceil(pages * often[1] - 1e-9)))


def cleaned(pages: list[Page], windows: np.ndarray, counts: np.ndarray, total: int) -> list[str]:
    """The pages' texts without blocks that substrings (sorted hashes, with their pages of the host's total) cover."""
    if not len(windows):
        return ["\n".join(b.text for b in page.blocks) for page in pages]
    s = Streams.of(pages)
    own = np.zeros(len(s.tokens), np.int64)
    if len(s.tokens):
        at, h = s.windows()
        k = np.minimum(np.searchsorted(windows, h), len(windows) - 1)
        n = np.where(windows[k] == h, counts[k], 0)
        for shift in range(WIDTH):
            np.maximum.at(own, at + shift, n)
    out, b = [], 0
    for page in pages:
        least = needed(total, OFTEN_WITHIN if page.marked else OFTEN)
        spans = list(zip(s.blocks[b : b + len(page.blocks)].tolist(), s.blocks[b + 1 : b + 1 + len(page.blocks)].tolist(), strict=True))
        b += len(page.blocks)
        count = [int(own[x + 1 : y].min()) for x, y in spans]
        gone = [n >= least for n in count]
        if page.marked and 2 * sum(gone) > len(gone):
            gone = [False] * len(gone)  # most of an article repeats: copies of it
        elif gone and all(gone):
            gone = [n == max(count) > min(count) for n in count]  # copies of a page: what is the most frequent goes
        out.append("\n".join(block.text for block, g in zip(page.blocks, gone, strict=True) if not g))
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit(""))


def _held(batches: Iterator[pa.RecordBatch], flush: Callable, budget: int) -> Iterator[pa.RecordBatch]:
    """Collects the HTML of (host, html) rows by host; a host's goes to flush() once it has `budget` bytes, or memory is short."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            held.setdefault(host, []).append(html or "")
            size[host] = size.get(host, 0) + len(html or "")
            if size[host] >= budget:
                yield from flush(host, held.pop(host))
                del size[host]
            elif sum(size.values()) >= 8 * budget if len(size) > 8 else False:
                host = max(size, key=size.__getitem__)
                yield from flush(host, held.pop(host))
                del size[host]
    for host, pages in held.items():
        yield from flush(host, pages)


def _proposed(budget: int):
    def flush(host: str, html: list[str]) -> Iterator[pa.RecordBatch]:
        h, n = repeated(Streams.of([Page.of(x) for x in html]))
        h = h[n >= len(html) * OFTEN[1] - 1e-9]
        if len(h):
            yield pa.record_batch({"host": pa.array([host] * len(h), pa.string()), "window": pa.array(h)})

    return lambda batches: _held(batches, flush, budget)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages have each proposed substring (html, host, windows)."""
    total: dict[tuple[str, int], int] = {}
    for batch in batches:
        for r in batch.to_pylist():
            _, h = Streams.of([Page.of(r["html"] or "")]).windows()
            for w in np.intersect1d(h, np.array(r["windows"], np.int64)).tolist():
                total[r["host"], w] = total.get((r["host"], w), 0) + 1
    if total:
        yield pa.record_batch({"host": pa.array([h for h, _ in total], pa.string()), "window": pa.array([w for _, w in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())})


OUT = "id long, url string, text string"


def _answer(rows: list[dict], texts: list[str]) -> pa.RecordBatch:
    return pa.record_batch({"id": pa.array([r["id"] for r in rows], pa.int64()), "url": pa.array([r["url"] for r in rows], pa.string()), "text": pa.array(texts, pa.string())})


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of small hosts: rows come by host, each group whole."""
    held: list[dict] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            pages = [Page.of(r["html"] or "") for r in held]
            h, n = repeated(Streams.of(pages)) if len(pages) >= OFTEN[0] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            h, n = h[n >= OFTEN[0]], n[n >= OFTEN[0]]
            order = np.argsort(h)
            yield _answer(held, cleaned(pages, h[order], n[order], len(pages)))
            held.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if held and held[-1]["host"] != r["host"]:
                yield from flush()
            held.append(r)
    yield from flush()


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages whose host's repeated substrings come with them (windows, counts, pages)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            rows = batch.slice(k, 200).to_pylist()
            texts = []
            for r in rows:
                h, n = np.array(r["windows"] or [], np.int64), np.array(r["counts"] or [], np.int64)
                order = np.argsort(h)
                texts += cleaned([Page.of(r["html"] or "")], h[order], n[order], r["pages"] or 1)
            yield _answer(rows, texts)


def _carried(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= CARRIED else df


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = SHARD) -> DataFrame:
    """A row (id, url, text) for each page: its main text, blocks one a line, empty where there is none.

    Null pages are empty; pages without a host are judged by their markup alone; identifiers may be null or repeated. A
    block goes where substrings that a third of its host's pages and at least three have cover all its words; within a marked
    article two thirds, and four, and not if those are more than half of its blocks. A page that would go as a whole keeps what fewer
    pages have than its most frequent blocks, or all of it. Pages are read whole; other columns don't matter.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    hosts = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    large = table(hosts.where(F.col("bytes") > shard).select("host", "pages", F.ceil(F.col("bytes") / shard).alias("shards")))
    sized = rows.join(_carried(large), "host", "left")
    small = sized.where("pages is null and host <> ''").select("id", "url", "host", "html").repartition(F.col("host")).sortWithinPartitions("host")
    texts = small.mapInArrow(_by_group, OUT)
    own = sized.where("pages is not null")
    dense = F.col("pages") >= DENSE * rows.rdd.getNumPartitions()
    apart = own.where(~dense).select("host", "html", F.pmod(F.xxhash64("url"), F.col("shards")).alias("shard")).repartition(F.col("host"), F.col("shard"))
    proposed = table(own.where(dense).select("host", "html").unionByName(apart.select("host", "html")).mapInArrow(_proposed(shard), "host string, window long").distinct())
    by_host = _carried(proposed).groupBy("host").agg(F.collect_list("window").alias("windows")) if not proposed.isEmpty() else None
    if by_host is None:
        known = own.select("id", "url", "html", "pages", F.array().cast("array<long>").alias("windows"), F.array().cast("array<long>").alias("counts"))
    else:
        counted = own.select("host", "html").join(_carried(table(by_host)), "host").mapInArrow(_counted, "host string, window long, n long").groupBy("host", "window").agg(F.sum("n").alias("n"))
        often = counted.join(_carried(large), "host").where((F.col("n") >= OFTEN[0]) & (F.col("n") >= F.col("pages") * OFTEN[1] - 1e-9))
        final = table(often.groupBy("host").agg(F.collect_list(F.struct("window", "n")).alias("w")).select("host", F.col("w.window").alias("windows"), F.col("w.n").alias("counts")))
        known = own.join(_carried(final), "host", "left").select("id", "url", "html", "pages", "windows", "counts")
    alone = sized.where("host = ''").select("id", "url", "html", F.lit(1).cast("long").alias("pages"), F.array().cast("array<long>").alias("windows"), F.array().cast("array<long>").alias("counts"))
    return texts.unionByName(known.unionByName(alone).mapInArrow(_by_row, OUT))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
