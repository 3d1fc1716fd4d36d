"""Secret scanning with one combined deterministic automaton for all rules.

The rules are compiled together (see automaton.py) and a text's bytes pass
through the transition rows once. When a state says that a rule has a match
ending here, the rule's reversed automaton finds the leftmost start after the
rule's previous match and its forward automaton the longest end. A match that
the state means may begin inside the previous one; behind a rule's first match
its own automaton therefore goes along, from event to event, and says whether
one begins after it. Every byte is read a bounded number of times a rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._shared import per_text, small_rows
from .automaton import compile_rules, parse, reverse, shortest


@dataclass(frozen=True)
class Rule:
    """Patterns count as little as they can: counters that overlap multiply the combined states, `least` costs none.

    A match counts if what follows its longest `head` (all of it without one) has `least` bytes; a match that is too short still uses up its bytes.
    """

    kind: str
    pattern: str
    any_case: bool = False
    least: int = 0
    head: str = ""


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# The three base rules, then the added ones in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", ASSIGN + r"[A-Za-z0-9+/_.=\-]+", True, 8, ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    # eight keep prose from raising events; shorter runs fail anyway
    Rule("hex", "[0-9a-f]{8,}", least=32),
)
ADDED_RULES = (
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z\-]+", least=20),
    Rule("web_token", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", least=40),
)
RULES = BASE_RULES + ADDED_RULES
SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple:
    """The combined automaton, and by rule the searching, forward, reversed and head automata; made on the driver, a few MB."""
    trees = [parse(r.pattern, r.any_case) for r in rules]
    # that a match ends is all the combined states must tell; how far it goes on is the forward automaton's matter
    ends = [shortest(t) for t in trees]
    each = [(compile_rules([t], search=False), compile_rules([reverse(t)], search=False), compile_rules([parse(r.head, r.any_case)], search=False) if r.head else None) for r, t in zip(rules, trees, strict=True)]
    return compile_rules(ends, search=True), [compile_rules([t], search=True) for t in ends], *zip(*each, strict=True)


class Scanner:
    """find(data) -> [(rule index, start, end)] in bytes, by start, then rule; the matches of one rule don't overlap."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, tables: tuple | None = None) -> None:
        self.rules = rules
        combined, self.search, self.forward, self.backward, self.heads = tables or compiled(rules)
        self.classes = combined.classes
        # a row holds the next rows themselves and ends with the rules it accepts: one look-up a byte
        self.rows: list[list] = [[] for _ in combined.rows]
        for row, targets, accepted in zip(self.rows, combined.rows, combined.accepts, strict=True):
            row.extend([self.rows[t] for t in targets])
            row.append(sorted(accepted))

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        free = [0] * len(self.rules)
        seen: dict[int, tuple[int, int]] = {}  # rule: bytes that its own automaton has read, and its state
        row = self.rows[0]
        for i, c in enumerate(data.translate(self.classes)):
            row = row[c]
            if row[-1]:
                for rule in row[-1]:
                    if i < free[rule] or (rule in seen and not self._begins_after(rule, seen, data, i + 1)):
                        continue
                    start = self.backward[rule].longest(data, i, free[rule] - 1, -1) + 1
                    free[rule] = end = self.forward[rule].longest(data, start, len(data))
                    seen[rule] = (end, 0)
                    counted = self.heads[rule].longest(data, start, end) if self.heads[rule] else start
                    if end - counted >= self.rules[rule].least:
                        found.append((rule, start, end))
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _begins_after(self, rule: int, seen: dict, data: bytes, stop: int) -> bool:
        """Whether a match that ends at `stop` begins behind the rule's previous one."""
        search = self.search[rule]
        at, state = seen[rule]
        for c in data[at:stop].translate(search.classes):
            state = search.rows[state][c]
        seen[rule] = (stop, state)
        return bool(search.accepts[state])

    def spans(self, data: bytes) -> list[dict]:
        """The same in code points, as rows."""
        found = self.find(data)
        if not found:
            return []
        if data.isascii():
            place = lambda p: p
        else:
            edges, at, chars, places = sorted({p for _, *both in found for p in both}), 0, 0, {}
            for p in edges:
                chars += len(data[at:p].decode("utf-8", "replace"))
                at, places[p] = p, chars
            place = places.__getitem__
        return [{"kind": self.rules[r].kind, "start": place(a), "end": place(b)} for r, a, b in found]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row, spans in code points by start, then rule.

    A null or empty text has no spans; repeated rows and ids give a row each;
    an empty table gives none; other columns are ignored. No shuffle.
    """

    tables = compiled(rules)

    def make():
        scanner = Scanner(rules, tables)
        return lambda data: (scanner.spans(data),)

    return per_text(docs, {"doc_id": id_col}, text_col, [("spans", ArrayType(SPAN))], make)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in the text replaced by <kind>, overlapping ones by the first kind; columns and nulls stay as they are, an empty table stays empty."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow can't read names with dots
    arrow = to_arrow_schema(plain.schema)
    at = docs.columns.index(text_col)

    tables = compiled(rules)

    def run(batches):
        scanner = Scanner(rules, tables)
        for batch in small_rows(batches):
            texts = batch.column(at).to_pylist()
            changed = False
            for i, text in enumerate(texts):
                if not text:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                if found := scanner.find(data):
                    out, done = [], 0
                    for rule, start, end in found:
                        if start >= done:
                            out += [data[done:start], f"<{scanner.rules[rule].kind}>".encode()]
                        done = max(done, end)
                    texts[i], changed = (b"".join(out) + data[done:]).decode("utf-8", "surrogatepass"), True
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=True)]
            if changed:
                columns[at] = pa.array(texts, type=arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as a string, from scan_secrets()."""
    base = [r.kind for r in BASE_RULES]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[of(k) for k in base],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
