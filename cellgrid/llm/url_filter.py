"""URL filters: a trie over reversed host labels and path segments; the longest of the fitting allow and block entries decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import others

#: Largest number of rule characters that one broadcast trie holds. A longer list is dealt to several tries, applied one after another.
MAX_TRIE_CHARS = 8_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(entries: Iterable[tuple[str, str]]) -> list[Rule]:
    """(verdict, 'host/path') entries. The host is lower-cased; what follows it, from the first '/', is the path."""
    rules = []
    for verdict, entry in entries:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} is neither allow nor block")
        host, slash, path = entry.partition("/")
        rules.append(Rule(verdict, host.lower(), slash + path))
    return rules


class Trie:
    """Host labels from the right, then path segments. A node's last step may be part of a segment, as paths fit by prefix: its entries are looked up by the segment's beginnings of
    the lengths that occur, longest first.

    Of the fitting rules the longest text wins, then the longer host; a rule listed both ways blocks."""

    def __init__(self, rules: Iterable[Rule]):
        self.hosts: dict = {}
        for rule in rules:
            node = self.hosts
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            paths = node.setdefault("/", {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                paths = paths.setdefault(segment, {})
            ends = paths.setdefault("/", {})
            if rest not in ends or rule.verdict == "block":
                ends[rest] = rule
        self._order(self.hosts)

    def _order(self, node: dict) -> None:
        todo = [x for n in self._nodes(node) if (x := n.get("/"))]
        while todo:
            paths = todo.pop()
            for segment, below in paths.items():
                if segment != "/":
                    todo.append(below)
            if ends := paths.get("/"):
                paths["/"] = (sorted({len(rest) for rest in ends}, reverse=True), ends)

    @staticmethod
    def _nodes(node: dict) -> Iterator[dict]:
        todo = [node]
        while todo:
            yield (now := todo.pop())
            todo += [below for label, below in now.items() if label != "/"]

    def match(self, host: str, path: str) -> Rule | None:
        best, node = None, self.hosts
        segments = path.split("/")
        best = self._paths(node, segments, best)
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            best = self._paths(node, segments, best)
        return best

    @staticmethod
    def _paths(node: dict, segments: list[str], best: Rule | None) -> Rule | None:
        paths = node.get("/")
        for segment in segments if paths is not None else ():
            lengths, ends = paths.get("/", ((), {}))
            rule = next((ends[segment[:n]] for n in lengths if segment[:n] in ends and n <= len(segment)), None)
            if rule is not None and (best is None or (len(rule.text), len(rule.host)) >= (len(best.text), len(best.host))):
                best = rule
            paths = paths.get(segment)
            if paths is None:
                break
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url", default: str = "allow", max_trie_chars: int = MAX_TRIE_CHARS) -> DataFrame:
    """Adds host, path, rule and verdict to each row; columns of these names are replaced.

    Null and malformed urls have an empty host and path, fit no rule and get the default verdict. No shuffle: each trie is broadcast,
    holds at most max_trie_chars characters of rules, and passes over further tries keep the longer match."""
    parsed = sorted(parse_rules(rules), key=lambda r: (r.host, r.path, r.verdict))
    shards: list[list[Rule]] = [[]]
    used = 0
    for rule in parsed:
        if used + len(rule.text) > max_trie_chars and shards[-1]:
            shards.append([])
            used = 0
        shards[-1].append(rule)
        used += len(rule.text)
    host, path = url_parts(F.col(url_col).cast("string"))
    out = df.select(*others(df, ["host", "path", "rule", "verdict", "_rule_host"]), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).alias("_rule_host"))
    for shard in shards:
        out = _apply(out, shard)
    return out.drop("_rule_host")


def _apply(df: DataFrame, shard: list[Rule]) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(Trie(shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = trie.value, {}
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("host", "path", "rule", "verdict", "_rule_host")}
            cols = {n: batch.column(i).to_pylist() for n, i in at.items()}
            for i, key in enumerate(zip(cols["host"], cols["path"], strict=True)):
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[key] = tree.match(*key)
                rule, old = seen[key], cols["rule"][i]
                if rule is not None:
                    new, had = (len(rule.text), len(rule.host)), (len(old) if old is not None else -1, cols["_rule_host"][i])
                    if new > had or (new == had and rule.verdict == "block"):
                        cols["rule"][i], cols["verdict"][i], cols["_rule_host"][i] = rule.text, rule.verdict, len(rule.host)
            arrays = list(batch.columns)
            for n, i in at.items():
                arrays[i] = pa.array(cols[n], type=batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
