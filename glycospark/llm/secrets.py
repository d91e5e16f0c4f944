"""Secret scan through a trigram index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every
match satisfies.  The index holds postings for the trigrams of these queries; a text that
satisfies a rule's query is its candidate and is searched with the rule itself.  Rules
without mandatory trigrams search every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, settle, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN, ACCESS, HEX = BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # for the next two, asking for the length in the pattern finds the same spans as dropping short matches
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
MASK = "[SECRET]"

# --- trigram queries --------------------------------------------------------------

#: A query is True (no restriction), a trigram, or ("and" | "or", (queries...)).
ALL = True
FEW = 64  # strings that are spelt out at once


def _join(kind: str, parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and ALL in parts:
        return ALL
    if kind == "or":  # what asks for more than another alternative adds nothing
        asked = {p: {p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else {p} for p in parts}
        parts = [p for p in parts if not any(asked[q] < asked[p] for q in parts)]
    parts = [p for p in parts if p is not ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _any_of(strings: set[str]) -> object:
    """One of the strings occurs."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(code: int) -> str:
    char = chr(code)
    return char.lower() if char.isascii() else char


def _derive(items) -> tuple[set[str] | None, object]:
    """(all strings that the items can match, if few; a query that each match satisfies)."""
    run, clauses, whole = {""}, [], True
    for op, arg in items:
        strings, query = None, ALL
        if op is C.LITERAL:
            strings = {_fold(arg)}
        elif op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
            size = sum(1 if k is C.LITERAL else v[1] - v[0] + 1 for k, v in arg)
            if size <= FEW:
                strings = {_fold(c) for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
        elif op is C.SUBPATTERN:
            strings, query = _derive(arg[-1])
        elif op is C.BRANCH:
            options = [_derive(x) for x in arg[1]]
            if all(s is not None for s, _ in options):
                strings = set().union(*(s for s, _ in options))
            query = _join("or", [q for _, q in options])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            own, inside = _derive(inner)
            if own is not None and most == 1:
                strings = own | {""} if least == 0 else own
            elif least:
                query = inside
        elif op is C.AT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= FEW:
            run = {a + b for a, b in product(run, strings)}
            continue
        clauses.append(_any_of(run))
        run, whole = strings if strings is not None and len(strings) <= FEW else {""}, False
        clauses.append(query)
    return run if whole else None, _join("and", [*clauses, _any_of(run)])


def trigram_query(pattern: str) -> object:
    """A Boolean query over lower-case trigrams that holds for each text with a match."""
    return _derive(_parser.parse(pattern))[1]


def _trigrams(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is ALL else set().union(*map(_trigrams, query[1]))


def _holds(query: object, found: str) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, found) for q in query[1]])


def postings(docs: DataFrame, trigrams: list[str], *, text_col: str = "text") -> DataFrame:
    """The index: one row ``(_llm_k1, _llm_k2, trigram)`` for each of the trigrams that a text has; docs carry the keys."""
    low = docs.select("_llm_k1", "_llm_k2", ascii_lower(text_of(text_col)).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.withColumn("_found", found).select("_llm_k1", "_llm_k2", F.explode_outer("_found").alias("trigram")).where("trigram IS NOT NULL")


# --- search -----------------------------------------------------------------------


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart; rows that share them are equal and have equal results."""
    return F.xxhash64(id_col, text_col).alias("_llm_k1"), F.xxhash64(text_col, F.length(text_col), id_col).alias("_llm_k2")


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans (start, place, end, kind) of a rule, in code points; ``place`` is the rule's rank among equals.

    The pieces between matches and the matches themselves, laid end to end, give the positions.
    """
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,part:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
        F.when(
            x["part"] >= rule.least,
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(place).alias("place"), (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"), x["part"].alias("part"))),
            ),
        ).otherwise(acc["out"]).alias("out"),
    )
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``_llm_spans``: all spans of all rules, by start, then by the rules' order."""
    queries = {rule: trigram_query(rule.pattern) for rule in rules}
    needed = sorted(set().union(*map(_trigrams, queries.values())))
    keyed = docs.withColumns(dict(zip(("_llm_k1", "_llm_k2"), _keys(id_col, text_col))))
    rows = keyed
    if needed:
        index = settle(postings(keyed, needed, text_col=text_col).distinct(), "postings")
        met = index.groupBy("_llm_k1", "_llm_k2").agg(F.collect_set("trigram").alias("_have"))
        names = [F.when(_holds(q, "_have"), F.lit(r.kind)) for r, q in queries.items() if q is not ALL]
        met = met.select("_llm_k1", "_llm_k2", F.array_compact(F.array(*names)).alias("_llm_rules")).where(F.size("_llm_rules") > 0)
        rows = keyed.join(met, ["_llm_k1", "_llm_k2"], "left")
    text, parts = text_of(text_col), []
    for place, (rule, q) in enumerate(queries.items()):
        found = spans_of(text, rule, place)
        parts.append(found if q is ALL else F.when(F.array_contains("_llm_rules", rule.kind), found).otherwise(F.array().cast("array<struct<start:int,place:int,end:int,kind:string,part:int>>")))
    return rows.withColumn("_llm_spans", F.array_sort(F.concat(*parts))).select(*docs.columns, "_llm_spans")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and ``spans``, an array of (kind, start, end).

    Null and empty texts have no spans; repeated rows each get theirs; an empty table gives
    an empty result; other columns are ignored.
    """
    found = with_spans(docs.select(id_col, text_col), rules, id_col=id_col, text_col=text_col)
    return found.select(id_col, F.transform("_llm_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each span masked (overlapping ones as one), and their length in code points brought up to date.

    Nothing is dropped; texts without spans, null ones included, stay as they are.
    """
    found = with_spans(docs, rules, id_col=id_col, text_col=text_col)
    text = F.col(text_col)
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).alias("out"),
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    masked = F.aggregate("_llm_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    out = found.withColumn("_llm_masked", F.when(F.size("_llm_spans") > 0, masked).otherwise(text))
    columns = {text_col: F.col("_llm_masked")}
    if chars_col in docs.columns:
        columns[chars_col] = F.when(F.size("_llm_spans") > 0, F.length("_llm_masked").cast("bigint")).otherwise(F.col(chars_col))
    return out.withColumns(columns).select(*docs.columns)
