"""Secret scans through a trigram inverted index (DataFrame functions only).

From each rule's regular expression a Boolean trigram query is derived: alternatives of sets of trigrams that
a match cannot do without. The index holds postings, rows (trigram, text), a text being named by a hash. A query's
postings are intersected: they meet the query's terms, and a text is a candidate of a rule where it has every trigram of an
alternative. Only candidates are verified with the expression; rules without a mandatory trigram verify every text.

Texts that lack the rarest-looking trigram of every alternative cannot be candidates; they are neither indexed nor moved. The others
meet their candidate rules by their hash, once; a hash that two texts share makes candidates too many, never too few.

Edge cases: a null text is empty and has no spans (counts 0, the digest of nothing, empty spans); spans count
code points, end exclusive; matches of one rule do not overlap, matches of different rules may; repeated rows give
equal rows; texts with very many matches take time in proportion to their length; an empty table gives an empty result. Columns other than the
named ones are ignored; ``redact`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import inline_rows, let, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def any_case(word: str) -> str:
    """A pattern for an ASCII word with letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])

#: Patterns of secrets. Base rules first, in their order.
RULES = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # The shorter matches of AKIA[A-Z0-9]+ and [0-9a-f]+ fail; as the class takes all that it can, none hides a longer one.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
]

#: Strings of an exact set, and alternatives of a query, beyond which they are widened.
MOST = 64
#: Postings to intersect for an alternative.
DEEP = 3
Query = list[frozenset[str]]
ALWAYS: Query = [frozenset()]


def both(a: Query, b: Query) -> Query:
    out = list(dict.fromkeys(x | y for x, y in product(a, b)))
    return out if len(out) <= MOST else min(a, b, key=len)


def needs(strings: set[str] | None) -> Query:
    """What a text that holds one of the strings cannot do without."""
    if strings is None or any(len(s) < 3 for s in strings):
        return ALWAYS
    return list(dict.fromkeys(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which every match of ``pattern`` has whole."""
    exact, must = Pattern(pattern).whole()
    query = both(must, needs(exact))
    query = [a for a in query if not any(b < a for b in query)]  # what a part asks for, the whole does too
    return list(dict.fromkeys(map(thinned, query)))


def thinned(alternative: frozenset[str]) -> frozenset[str]:
    """At most DEEP trigrams of the alternative, spread over their order: still none that a match can do without."""
    grams = sorted(alternative)
    return frozenset(grams[k * (len(grams) - 1) // (DEEP - 1)] for k in range(DEEP)) if len(grams) > DEEP else alternative


#: The strings that a piece of a pattern can match, if they are few, and the query beside them.
Known = tuple[set[str] | None, Query]


class Pattern:
    """Reads literals, escapes, classes, groups, alternatives and repetitions; what else there is matches anything."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def whole(self) -> Known:
        known = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"a group that was not opened: {self.text}")
        return known

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1 : self.at]

    def alternatives(self) -> Known:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        if all(e is not None and q == ALWAYS for e, q in branches):
            exact = set().union(*(e for e, _ in branches))
            if len(exact) <= MOST:
                return exact, ALWAYS
        own = [q for e, m in branches for q in both(m, needs(e))]
        return None, list(dict.fromkeys(own)) if len(own) <= MOST else ALWAYS

    def sequence(self) -> Known:
        now: set[str] = {""}
        must, whole = ALWAYS, True
        while self.peek() not in ("", "|", ")"):
            exact, own = self.repeated(self.atom())
            must = both(must, own)
            if exact is not None and len(now) * len(exact) <= MOST:
                now = {a + b for a in now for b in exact}
                continue
            must, whole = both(both(must, needs(now)), needs(exact)), False
            now = {""}
        return (now, must) if whole else (None, both(must, needs(now)))

    def atom(self) -> Known:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                m = re.compile(r"\?(?::|P<\w+>|<\w+>)").match(self.text, self.at)
                if not m:
                    raise ValueError(f"a group of an unknown kind: {self.text}")
                self.at = m.end()
            known = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group that is not closed: {self.text}")
            return known
        if c == "[":
            return self.letters()
        if c in "^$":
            return {""}, ALWAYS
        if c == ".":
            return None, ALWAYS
        if c == "\\":
            one = self.escaped()
            return ({one.lower()}, ALWAYS) if one is not None else (None, ALWAYS)
        return {c.lower()}, ALWAYS

    def escaped(self) -> str | None:
        """The character after a backslash; None for a class, the empty text for a place."""
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if c in "bB":
            return ""
        if c.isalnum():
            return {"n": "\n", "t": "\t", "r": "\r"}.get(c)
        return c

    def letters(self) -> Known:
        found: set[str] | None = set()
        if self.peek() == "^":
            found = None
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            lo = self.escaped() if c == "\\" else c
            hi = lo
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                hi = self.escaped() if c == "\\" else c
            if found is not None and lo and hi and ord(hi) - ord(lo) < 8:
                found |= {chr(k).lower() for k in range(ord(lo), ord(hi) + 1)}
            else:
                found = None
        self.take()
        return (found, ALWAYS) if found is not None and len(found) <= 8 else (None, ALWAYS)

    def repeated(self, known: Known) -> Known:
        m = re.compile(r"[*+?]|\{(\d*)(,?)(\d*)\}").match(self.text, self.at)
        if not m:
            return known
        self.at = m.end() + (self.text[m.end() : m.end() + 1] in ("?", "+") and m.end() < len(self.text))
        if m[0] in "*+?":
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[0]]
        else:
            least = int(m[1] or 0)
            most = int(m[3]) if m[3] else None if m[2] else least
        exact, own = known
        if exact is not None and own == ALWAYS and most is not None and most <= 4 and sum(len(exact) ** n for n in range(least, most + 1)) <= MOST:
            return {"".join(p) for n in range(least, most + 1) for p in product(exact, repeat=n)}, ALWAYS
        if not least:
            return None, ALWAYS
        several = {"".join(p) for p in product(exact, repeat=least)} if exact is not None and len(exact) ** least <= MOST else exact
        return None, both(own, needs(several))


def queries_of(rules: list[Rule]) -> dict[int, Query]:
    """The queries of the rules that have one, by the rules' places."""
    found = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    return {k: q for k, q in found.items() if frozenset() not in q}


#: Letters from the frequent to the rare ones, in prose.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def rarest(alternative: frozenset[str]) -> str:
    """The trigram with the rarest letters: what is no letter is rarer."""
    return max(alternative, key=lambda g: (sum(FREQUENT.index(c) if c in FREQUENT else 30 for c in g), g))


def leads(rules: list[Rule]) -> list[str]:
    """Trigrams of which a text has one, if it is a candidate of any indexed rule."""
    return sorted({rarest(a) for q in queries_of(rules).values() for a in q})


def has_any(low: Column, grams: list[str]) -> Column:
    found = F.lit(False)
    for g in grams:
        found = found | F.contains(low, F.lit(g))
    return found


def is_indexed(text: Column, rules: list[Rule]) -> Column:
    """Whether a text may be a candidate; it is lower-cased once."""
    return let(F.lower(text), lambda low: has_any(low, leads(rules)))


def postings(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The index, as rows (trigram, text): the rules' trigrams, in either case, of the texts that may be candidates; texts by hash."""
    grams = sorted({g for q in queries_of(rules).values() for a in q for g in a})

    def held(low: Column) -> Column:
        return F.when(has_any(low, leads(rules)), F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams])))

    return docs.select(F.xxhash64(text).alias("text"), F.explode(let(F.lower(text), held)).alias("trigram")).select("trigram", "text")


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(text, rules): for each text with every trigram of an alternative, a bit for each rule that has one."""
    terms = []
    for k, query in sorted(queries_of(rules).items()):
        for j, alternative in enumerate(query):
            terms += [{"trigram": g, "rule": k, "alternative": j, "bit": 1 << i, "all": (1 << len(alternative)) - 1} for i, g in enumerate(sorted(alternative))]
    table = F.broadcast(inline_rows(index.sparkSession, terms))  # MOST alternatives of DEEP trigrams a rule at most
    met = index.join(table, "trigram").groupBy("text", "rule", "alternative", "all").agg(F.bit_or("bit").alias("has")).where("has = all")
    return met.groupBy("text").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


#: Spans of a block, inside which places are added up.
BLOCK = 256
PLACE = "array<struct<start:int,end:int>>"


def in_blocks(items: Column, block: Callable[[Column, Column], Column], total: Callable[[Column, Column], Column]) -> Column:
    """The flattened ``block(items of a block, total of those before)``; the total starts at 0 and ``total(total, items of a block)``
    carries it on. A fold over all items would copy its result at each."""

    def of(whole: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda k: F.slice(whole, k * BLOCK + 1, BLOCK))
        start = F.array(F.lit(0))
        return let(parts, lambda p: let(F.aggregate(p, start, lambda sums, x: F.concat(sums, F.array(total(F.element_at(sums, -1), x)))), lambda sums: F.flatten(F.zip_with(p, F.slice(sums, 1, F.size(p)), block))))

    return let(items, lambda x: F.when(F.size(x) > 0, of(x)))


SPAN_TYPE = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of the rule's matches, null without any; what stands between them gives their places."""
    matches, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    own = (lambda m: m) if not rule.group else (lambda m: F.regexp_extract(m, rule.pattern, rule.group))
    # The last piece between has no match after it.
    pieces = F.transform(F.arrays_zip(matches.alias("m"), between.alias("g")), lambda z: F.struct(F.length(z["g"]).alias("g"), F.length(z["m"]).alias("m"), (F.length(own(z["m"])) >= rule.least).alias("valid")))
    sizes = F.filter(pieces, lambda z: z["m"].isNotNull())

    def block(part: Column, before: Column) -> Column:
        def step(state: Column, z: Column) -> Column:
            start = state["at"] + z["g"]
            end = start + z["m"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            return F.struct(end.alias("at"), F.when(z["valid"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(before.alias("at"), F.array().cast(SPAN_TYPE).alias("spans")), step)["spans"]

    return in_blocks(sizes, block, lambda before, part: before + F.aggregate(part, F.lit(0), lambda n, z: n + z["g"] + z["m"]))


def with_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """_row (all columns of ``docs``), and _spans: every rule's spans in its text by start, then in the rules' order."""
    queries = queries_of(rules)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_body"))
    indexed = is_indexed(F.col("_body"), rules) if queries else F.lit(False)
    found = written(candidates(postings(docs.where("text is not null").select("text"), rules), rules), "secret-candidates") if queries else None

    def verified(part: DataFrame, known: list[int]) -> DataFrame:
        lists = []
        for rank in known:
            body, rule = F.col("_body"), rules[rank]
            is_candidate = F.col("_rules").bitwiseAND(F.lit(1 << rank).cast("long")) != 0 if rank in queries else F.rlike(body, F.lit(rule.pattern))
            lists.append(F.coalesce(F.when(is_candidate, spans_of(body, rule, rank)), F.array().cast(SPAN_TYPE)))
        spans = F.array_sort(F.concat(*lists)) if lists else F.array().cast(SPAN_TYPE)
        return part.select("_row", spans.alias("_spans"))

    free = [k for k in range(len(rules)) if k not in queries]
    if found is None:
        return verified(rows, free)
    met = rows.where(indexed).withColumn("text", F.xxhash64("_body")).join(found.withColumnRenamed("rules", "_rules"), "text", "left")
    met = met.withColumn("_rules", F.coalesce("_rules", F.lit(0).cast("long")))
    return verified(met, list(range(len(rules)))).unionByName(verified(rows.where(~indexed), free))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans for each row of ``docs``."""
    base = [r.kind for r in rules if r.base]
    rows = with_spans(docs.select("doc_id", "text"), rules)
    counts = [F.size(F.filter("_spans", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("_spans", lambda s: s["kind"].isin(base))
    return rows.select("_row.doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def struck(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""

    def block(part: Column, before: Column) -> Column:
        # From where the spans before ended to where the block's last one does.
        def piece(own: Column) -> Column:
            def step(state: Column, s: Column) -> Column:
                gap = F.substr(own, state["at"] - before + 1, s["start"] - state["at"])
                put = F.concat(state["out"], gap, F.lit(mark))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], put).otherwise(state["out"]).alias("out"))

            return F.aggregate(part, F.struct(before.alias("at"), F.lit("").alias("out")), step)["out"]

        return F.array(let(F.substr(text, before + 1, furthest(before, part) - before), piece))

    def furthest(before: Column, part: Column) -> Column:
        return F.aggregate(part, before, lambda at, s: F.greatest(at, s["end"]))

    tail = F.substr(text, furthest(F.lit(0), spans) + 1)
    return F.concat(F.array_join(in_blocks(spans, block, furthest), ""), tail)


def redact(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; n_chars follows the text; clean rows stay as they are."""
    hit = F.size("_spans") > 0
    done = F.when(hit, struck(F.col("_row.text"), F.col("_spans"), mark)).otherwise(F.col("_row.text"))
    rows = with_spans(docs, rules).select("_row", hit.alias("_hit"), done.alias("_done"))
    changed = {"text": F.col("_done")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_hit"), F.length("_done").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
