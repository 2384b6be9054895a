"""URL filter over a sorted digest array.

The rules (host suffix, path prefix, verdict) are laid down as one file: their 64-bit xxhash keys in ascending order, then the
offsets and bytes of the full rule strings. Every executor gets the file through Spark and maps it into memory, so only the
pages that a probe touches are read. A URL gives one probe for each trailing run of its host's labels and each rule path length
that occurs; all probes of a batch are searched at once in the key array, and a hit counts only when the stored string equals
the probed one, since keys may collide.

Size: one file holds at most ``most_rules`` rules. A longer list is laid down as several files by key range and the longest rule
over all of them wins, so any list works and the driver holds one file's worth at a time.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the
end. A null URL, or one without ``://``, has an empty host and path. Verdict: that of the longest rule (host and path together;
of equal ones, the smaller string, and of a rule given twice with both verdicts, block); without a rule the URL is not on the
list, so ``allow``. Null rule columns are skipped. Repeated URLs are judged one by one; an empty list allows everything.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 4_000_000
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"))


class DigestArray:
    """A mapped index file. ``digest_of`` can be replaced to force collisions in tests."""

    def __init__(self, path: str, digest_of=digest):
        head = np.memmap(path, np.uint64, "r", shape=(4,))
        self.n, n_lengths, n_bytes, self.most_labels = (int(x) for x in head)
        at = 32
        self.keys = np.memmap(path, np.uint64, "r", at, (self.n,)) if self.n else np.zeros(0, np.uint64)
        at += 8 * self.n
        self.ends = np.memmap(path, np.uint64, "r", at, (self.n + 1,))
        at += 8 * (self.n + 1)
        self.lengths = np.array(np.memmap(path, np.uint64, "r", at, (n_lengths,))).tolist() if n_lengths else []
        at += 8 * n_lengths
        self.blocks = np.memmap(path, np.uint8, "r", at, (self.n,)) if self.n else np.zeros(0, np.uint8)
        at += self.n
        self.bytes = np.memmap(path, np.uint8, "r", at, (n_bytes,)) if n_bytes else np.zeros(0, np.uint8)
        self.digest_of = digest_of

    @staticmethod
    def write(path: str, rules: list[tuple[str, bool]], digest_of=digest) -> None:
        """``rules``: distinct rule strings (host, then path) and whether they block."""
        order = sorted((digest_of(r), r, b) for r, b in rules)
        raw = [r.encode("utf-8", "surrogatepass") for _, r, _ in order]
        lengths = sorted({len(r) - len(r.split("/", 1)[0]) for _, r, _ in order})
        labels = max((r.split("/", 1)[0].count(".") + 1 for _, r, _ in order), default=0)
        with open(path, "wb") as out:
            np.array([len(order), len(lengths), sum(map(len, raw)), labels], np.uint64).tofile(out)
            np.array([k for k, _, _ in order], np.uint64).tofile(out)
            np.cumsum([0] + [len(r) for r in raw]).astype(np.uint64).tofile(out)
            np.array(lengths, np.uint64).tofile(out)
            np.array([b for _, _, b in order], np.uint8).tofile(out)
            out.write(b"".join(raw))

    def probe(self, probes: list[str]) -> np.ndarray:
        """Place of each string among the rules, or -1."""
        if not probes or not self.n:
            return np.full(len(probes), -1)
        keys = np.array([self.digest_of(p) for p in probes], np.uint64)
        left = np.searchsorted(self.keys, keys, side="left")
        out = np.full(len(probes), -1)
        for k in np.flatnonzero((left < self.n) & (self.keys[np.minimum(left, self.n - 1)] == keys)):
            wanted = probes[k].encode("utf-8", "surrogatepass")
            at = int(left[k])
            while at < self.n and self.keys[at] == keys[k]:  # confirm, and pass over others of the same key
                if self.bytes[int(self.ends[at]):int(self.ends[at + 1])].tobytes() == wanted:
                    out[k] = at
                    break
                at += 1
        return out

    def judge(self, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[bool]]:
        hosts, paths, probes, owner = [], [], [], []
        for n, url in enumerate(urls):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            labels = host.rsplit(".", self.most_labels) if self.most_labels else []
            labels = labels if len(labels) <= self.most_labels else labels[1:]
            tails = [".".join(labels[k:]) for k in range(len(labels))] if host else []
            mine = [tail + path[:m] for tail in tails for m in self.lengths if m <= len(path)]
            probes += mine
            owner += [n] * len(mine)
        best: list[str | None] = [None] * len(urls)
        block = [False] * len(urls)
        found = self.probe(probes)
        for k in np.flatnonzero(found >= 0):
            n, rule = owner[k], probes[k]
            if best[n] is None or (-len(rule), rule) < (-len(best[n]), best[n]):
                best[n], block[n] = rule, bool(self.blocks[found[k]])
        return hosts, paths, best, block


def _lay_down(spark: SparkSession, rules: list[tuple[str, bool]]) -> str:
    """Write the index file on the driver, hand it to the executors, and return its name."""
    folder = tempfile.mkdtemp(prefix="tamiz-urls-")
    path = os.path.join(folder, "index")
    DigestArray.write(path, rules)
    with open(path, "rb") as f:
        name = f"urls-{hashlib.sha256(f.read()).hexdigest()[:24]}-{os.path.basename(folder)}"
    os.rename(path, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", most_rules: int = MOST_RULES) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``pages``. ``rules``: ``host, path, verdict``."""
    spark = pages.sparkSession
    listed = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND startswith(path, '/')")
              .select(F.concat(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path").alias("rule"),
                      (F.col("verdict") == "block").alias("block"))
              .groupBy("rule").agg(F.max("block").alias("block")))
    n_files = max(1, -(-listed.count() // most_rules))
    src = pages.select(pages[id_column].alias("id"), pages[url_column].alias("url"))
    id_type = src.schema["id"].dataType.simpleString()
    names = []
    for k in range(n_files):
        part = listed if n_files == 1 else listed.where(F.pmod(F.xxhash64("rule"), F.lit(n_files)) == k)
        names.append(_lay_down(spark, [(r["rule"], r["block"]) for r in part.toLocalIterator()]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [DigestArray(SparkFiles.get(name)) for name in names]
        for batch in batches:
            urls = batch.column(1).to_pylist()
            hosts, paths, best, block = arrays[0].judge(urls)
            for other in arrays[1:]:
                for n, (rule, b) in enumerate(zip(*other.judge(urls)[2:])):
                    if rule is not None and (best[n] is None or (-len(rule), rule) < (-len(best[n]), best[n])):
                        best[n], block[n] = rule, b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, pa.string()) for c in (hosts, paths, best, ["block" if b else "allow" for b in block])],
                names=["id", "host", "path", "rule", "verdict"])

    return src.mapInArrow(work, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_column)


def op4_url_filter(spark, folder: str) -> DataFrame:
    """Verdict of every page's URL under the five rules."""
    from tamiz.llm.store import table
    return filter_urls(table(spark, folder, "pages"), rule_frame(spark, RULES))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP4_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
    regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
fits AS (SELECT page_id, arg_min(rule_host || rule_path, length(rule_host || rule_path) * -1) AS rule,
    arg_min(rule_verdict, length(rule_host || rule_path) * -1) AS rule_verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM split s LEFT JOIN fits f ON s.page_id = f.page_id
"""
