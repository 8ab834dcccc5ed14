"""URL rules in a sorted digest array that workers memory-map.

A rule is a host and a path prefix with a verdict. Two arrays of 64-bit xxhash keys are sorted and
written to one file: the rules' hosts, each with the lengths of its paths, and the rules themselves. The
file goes to every executor once; its Python workers map it and share the pages. A batch of URLs is
probed in one binary search over all its host suffixes and, for hosts that hit, one over the path
prefixes of the lengths that host has. A key that hits is confirmed against the stored string, so a
collision of hashes changes nothing.

Defined results: the host is what stands after the first "://" up to /, ?, # or the end, A-Z
lower-cased; the path goes on up to ? or #. A null URL, or one without "://", has an empty host and path.
A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, of
equally long ones that with the longer host. Without a rule the verdict is the filter's default.
Repeated rules keep the last verdict given; rows are judged one by one, ties cannot occur among them.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import LOWER, UPPER, shared_dir

PARTS = re.compile(r"(?s)://([^/?#]*)([^?#]*)")
FOLD = str.maketrans(UPPER, LOWER)
VERDICTS = ("allow", "block")


def split_url(url: str | None) -> tuple[str, str]:
    m = PARTS.search(url or "")
    return (m[1].translate(FOLD), m[2]) if m else ("", "")


def _pack(texts: list[str], extra: dict[str, list[int]]) -> list[tuple[str, np.ndarray]]:
    raw = [t.encode() for t in texts]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in raw], np.uint64)
    order = np.argsort(keys, kind="stable")
    raw = [raw[i] for i in order]
    ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    parts = [("keys", keys[order]), ("ends", ends), ("text", np.frombuffer(b"".join(raw), np.uint8))]
    return parts + [(name, np.array([v[i] for i in order], np.int64)) for name, v in extra.items()]


def build_digest_file(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
    """Writes the arrays of (verdict, host, path) rules; the name carries the content's hash."""
    table = {(host.translate(FOLD), path): VERDICTS.index(verdict) for verdict, host, path in rules}
    lengths: dict[str, set[int]] = defaultdict(set)
    for host, path in table:
        lengths[host].add(len(path))
    hosts = sorted(lengths)
    flat, first = [], []
    for host in hosts:
        first.append(len(flat))
        flat += sorted(lengths[host])
    rows = sorted(table)
    blocks = [
        *(("host_" + n, a) for n, a in _pack(hosts, {"first": first, "count": [len(lengths[h]) for h in hosts]})),
        ("lengths", np.array(flat, np.int64)),
        *(("rule_" + n, a) for n, a in _pack([h + p for h, p in rows], {"host": [len(h) for h, _ in rows], "verdict": [table[r] for r in rows]})),
        ("labels", np.array([max((h.count(".") + 1 for h in hosts), default=0)], np.int64)),
    ]
    head, body = [], b""
    for name, a in blocks:
        body += b"\0" * (-len(body) % 8)
        head.append(f"{name} {a.dtype.str} {len(body)} {len(a)}")
        body += a.tobytes()
    top = ("\n".join(head) + "\n\n").encode()
    top += b"\0" * (-len(top) % 8)
    data = np.int64(len(top)).tobytes() + top + body
    path = os.path.join(folder, f"url-digests-{hashlib.sha256(data).hexdigest()[:24]}.bin")
    with open(path, "wb") as f:
        f.write(data)
    return path


class DigestArray:
    """The memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        top = int(np.frombuffer(held, np.int64, 1)[0])
        for line in held[8 : 8 + top].split(b"\n\n")[0].decode().split("\n"):
            name, kind, at, n = line.split()
            setattr(self, name, np.frombuffer(held, np.dtype(kind), int(n), 8 + top + int(at)))

    def find(self, kind: str, texts: list[str]) -> np.ndarray:
        """Row of each text in the array of that kind, -1 if it isn't there."""
        keys, ends, text = (getattr(self, f"{kind}_{x}") for x in ("keys", "ends", "text"))
        out = np.full(len(texts), -1, np.int64)
        if not len(keys) or not texts:
            return out
        raw = [t.encode() for t in texts]
        probe = np.array([xxhash.xxh64_intdigest(t) for t in raw], np.uint64)
        at = np.searchsorted(keys, probe)
        for i in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == probe)):
            k = at[i]
            while k < len(keys) and keys[k] == probe[i]:
                if text[ends[k] : ends[k + 1]].tobytes() == raw[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each (host, path), (None, None) without a rule."""
        most = int(self.labels[0])
        suffixes, owner = [], []
        for i, (host, _) in enumerate(parts):
            at = len(host)
            for _ in range(most):
                at = host.rfind(".", 0, at)
                suffixes.append(host[at + 1 :])
                owner.append(i)
                if at < 0:
                    break
        texts, of, split = [], [], []
        for s, i, k in zip(suffixes, owner, self.find("host", suffixes)):
            if k >= 0:
                path = parts[i][1]
                for n in self.lengths[self.host_first[k] : self.host_first[k] + self.host_count[k]]:
                    if n <= len(path):
                        texts.append(s + path[:n])
                        of.append(i)
                        split.append(len(s))
        best: dict[int, tuple[int, int, int]] = {}
        for t, i, h, k in zip(texts, of, split, self.find("rule", texts)):
            if k >= 0 and self.rule_host[k] == h:
                best[i] = max(best.get(i, (-1, -1, -1)), (len(t), h, int(k)))
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(parts)
        for i, (_, _, k) in best.items():
            rule = self.rule_text[self.rule_ends[k] : self.rule_ends[k + 1]].tobytes().decode()
            out[i] = (rule, VERDICTS[int(self.rule_verdict[k])])
        return out


def filter_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; nothing is shuffled and only two columns are read."""
    with tempfile.TemporaryDirectory(prefix="url-digests-") as folder:
        path = build_digest_file(rules, folder)
        name = os.path.basename(path)
        if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
            # Named by its content and kept in the shared folder, where executors that join later find it too.
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
            kept = hadoop.Path(f"{shared_dir(spark)}/url-digests/{name}")
            kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, hadoop.Path(f"file://{path}"), kept)
            spark.sparkContext.addFile(kept.toString())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            judged = digests.judge(parts)
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in judged], [v or default for _, v in judged]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)],
                ["row_id", "host", "path", "rule", "verdict"],
            )

    return (
        pages.selectExpr(f"`{id_col}` AS row_id", f"cast(`{url_col}` AS string) AS url")
        .mapInArrow(probe, f"row_id {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string")
    )
