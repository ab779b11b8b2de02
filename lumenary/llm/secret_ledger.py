"""Secret scans over an incremental ledger of blobs.

A blob is a text by content; every version of every path has one. The ledger holds which (blob, rule version)
pairs have been scanned and what was found. A run scans only pairs that the ledger lacks, each blob once
however many paths share it, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import maybe_among, whole
from lumenary.llm.tokens import slices
from lumenary.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """`pattern` finds spans, leftmost and without overlap; of them, those stay whose `group` has `least` characters.

    `hint` is a cheap pattern that every text with a span matches.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the base kinds; runs of one character class are found at their least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("code_host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<pair: string, start: long, end: long>>"
LEDGER = f"blob string, pairs array<string>, spans {SPANS}"


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    found = re.finditer(rule.pattern, text, rule.flags)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def new_entries(docs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, pairs, spans) for the pairs that `ledger` lacks; empty where there are none.

    Texts are scanned where they lie: a small set of bits says which blobs may be due, and a task scans a blob once
    however many of its rows have it. Only spans are shuffled; they meet the due pairs exactly.
    """
    rows = docs.select(whole(F.col(text_col).cast("string")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    blobs = rows.select("blob").distinct()
    every = F.array(*[F.lit(r.pair) for r in rules])
    if ledger is None:
        due = blobs.withColumn("pairs", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("seen"))
        due = blobs.join(seen, "blob", "left")
        due = due.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("pairs"))
    due = cut_lineage(due.filter(F.size("pairs") > 0))
    # the rules that some blob is due for: as many values as there are rules at most
    wanted = {p for (p,) in due.select(F.explode("pairs")).distinct().collect()}
    asked = [r for r in rules if r.pair in wanted]
    kind = pa.list_(pa.struct([("pair", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = "|".join(f"(?:{r.hint})" for r in asked)
        done: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                at = np.flatnonzero(pc.match_substring_regex(part.column("text"), hint).to_numpy(zero_copy_only=False)) if asked else []
                blobs, found = [], []
                for i in map(int, at):
                    blob = part.column("blob")[i].as_py()
                    if (mark := bytes.fromhex(blob)) not in done:
                        done.add(mark)
                        text = part.column("text")[i].as_py()
                        blobs.append(blob)
                        found.append([{"pair": r.pair, "start": a, "end": b} for r in asked for a, b in spans_of(text, r)])
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(found, kind)], names=["blob", "spans"])

    maybe = rows if ledger is None else rows.filter(maybe_among(due, "blob"))
    spans = maybe.mapInArrow(scan, f"blob string, spans {SPANS}").filter(F.size("spans") > 0).dropDuplicates(["blob"])
    found = due.join(spans, "blob", "left")
    mine = F.filter(F.coalesce("spans", F.array().cast(SPANS)), lambda s: F.array_contains("pairs", s["pair"]))
    return found.select("blob", "pairs", mine.alias("spans"))


def scan_documents(
    docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows to append).

    Findings are (id, blob, spans), one row per row of `docs`: spans of kind, start and end (code points, end
    exclusive) by start, then by the order of the rules. A null text is an empty text; rows that repeat a path
    or text are answered each; a null id is kept. Only the named columns are read.
    """
    fresh = cut_lineage(new_entries(docs, ledger, rules, id_col, text_col))
    every = fresh if ledger is None else ledger.select("blob", "pairs", "spans").unionByName(fresh)
    current = F.array(*[F.lit(r.pair) for r in rules])
    places = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.pair, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.filter(F.flatten(F.collect_list("spans")), lambda s: F.array_contains(current, s["pair"]))
    ranked = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), places[s["pair"]].alias("rule"), s["end"].alias("end")))))
    found = every.filter(F.size("spans") > 0).groupBy("blob").agg(
        F.transform(ranked, lambda s: F.struct(F.get(kinds, s["rule"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    )
    paths = docs.select(F.col(id_col).alias("id"), F.sha2(whole(F.col(text_col).cast("string")), 256).alias("blob"))
    empty = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    return paths.join(cut_lineage(found), "blob", "left").select("id", "blob", F.coalesce("spans", empty).alias("spans")), fresh
