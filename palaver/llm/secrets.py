"""Secret scans over a ledger of text versions, with DataFrame functions only.

Every text is a blob named by its SHA-256. The ledger says which rules, in which versions, have
scanned a blob and what they found; only unseen pairs of blob and rule version are scanned, each
distinct text once, and findings are joined back to every row (path) that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import all_of, settled, spare

REDACTED = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """`pattern` finds a secret; of group `value` (0: the whole match) at least `least` characters are asked for."""

    kind: str
    pattern: str
    version: int = 1
    value: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The first three kinds, in this order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", value=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
# A private key runs to its END line; where that is missing, over the header and base64 lines that follow.
# Repeats are bounded, as Java nests a call for each one, and parted, as DuckDB takes at most 1,000 nested ones.
# No part may hold two dashes, so a key never runs into the next.
_HEADERS = r"(?:[\r\n\x20]*[A-Za-z]+(?:-[A-Za-z]+)?:\x20[^\r\n]*){0,8}"
_LINES = r"""(?:[\x09-\x0D\x20"'\\,;:>|#*]*[A-Za-z0-9+/]{20,}={0,2})"""
_LAST = r"(?:\r?\n\x20*[A-Za-z0-9+/]{1,64}={0,2}(?:\r?\n|\z))?"
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,128}-{5,}END [A-Z ]*PRIVATE KEY-----"
    rf"|{_HEADERS}{_LINES}{f'{_LINES}{{0,25}}' * 16}{_LAST}|)"
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", PEM, version=2),
)
RULES = BASE + MORE
LEDGER = "blob string, rules array<string>, findings array<struct<kind:string,start:bigint,end:bigint>>"


def blob_of(text: str) -> Column:
    """The name of a text's content; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _matches(text: str, rule: Rule, number: int) -> Column:
    """All matches in order as (rule, index, gap before, length, good); empty where the rule finds nothing."""
    # One pattern eats the gap, then a match or the end of the text; groups: 1 the gap, 2 the match.
    pattern = F.lit(f"(?s)(.*?)({rule.pattern}|\\z)")

    def lengths(group):
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda x: F.length(x).cast("long"))

    zipped = F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("size"), lengths(2 + rule.value).alias("value"))
    full = F.transform(zipped, lambda m, i: F.struct(
        F.lit(number).alias("rule"), i.cast("long").alias("index"), m["gap"].alias("gap"), m["size"].alias("size"),
        ((m["size"] > 0) & (m["value"] >= rule.least)).alias("good"),
    ))
    kind = "array<struct<rule:int,index:bigint,gap:bigint,size:bigint,good:boolean>>"
    return F.when(F.col(text).rlike(rule.pattern), full).otherwise(F.array().cast(kind))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for `blobs` (blob, text, todo: names of the rules to run): blob, rules, findings.

    Matches of a rule are leftmost and do not overlap. Places are code points, the end exclusive;
    they are running sums over a text's matches, which Spark sorts and spills like any rows.
    """
    none = F.array().cast("array<struct<rule:int,index:bigint,gap:bigint,size:bigint,good:boolean>>")
    found = F.concat(*(
        F.when(F.array_contains("todo", rule.name), _matches("text", rule, i)).otherwise(none) for i, rule in enumerate(rules)
    ))
    matched = blobs.select("blob", "todo", F.explode_outer(found).alias("m")).select("blob", "todo", "m.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("blob", "rule").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    )
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    span = F.struct((F.col("upto") - F.col("size")).alias("start"), "rule", F.col("upto").alias("end"))
    return (
        matched.withColumn("upto", upto)
        .groupBy("blob").agg(F.first("todo").alias("rules"), F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("s"))
        .select("blob", "rules", F.transform("s", lambda x: F.struct(
            kinds[x["rule"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end")
        )).alias("findings"))
    )


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: every distinct text of `docs` under the rules (with versions) that have not seen it.

    Copies collapse in the tasks that read them, before anything is shuffled.
    """
    content = docs.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = content.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(rule.name) for rule in rules))
    if ledger is None:
        todo = distinct.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        open_rules = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        todo = distinct.join(seen, "blob", "left").select("blob", "text", open_rules.alias("todo")).filter(F.size("todo") > 0)
    return scan_blobs(todo, rules)


def _listed(findings: str, kinds: tuple[str, ...] | None = None) -> Column:
    some = F.filter(findings, lambda f: f["kind"].isin(*kinds)) if kinds else F.col(findings)
    return F.concat_ws(",", F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])))


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and all findings of the current rules, by start and then rule order, from ledger rows of any age."""
    order = F.array(*(F.lit(rule.kind) for rule in rules))
    current = F.array(*(F.lit(rule.name) for rule in rules))
    ranked = ledger.filter(F.size("findings") > 0).select(
        "blob", F.explode("findings").alias("f"), F.array_intersect("rules", current).alias("now")
    )
    kept = ranked.filter(F.exists("now", lambda r: F.substring_index(r, "@", 1) == F.col("f.kind")))
    place = F.struct(F.col("f.start").alias("start"), F.array_position(order, F.col("f.kind")).alias("rank"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"))
    return kept.groupBy("blob").agg(F.array_sort(F.collect_set(place)).alias("s")).select(
        "blob", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings")
    )


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(findings per row of `docs`, ledger): key, blob, findings (kind, start, end) of every row, and old and new ledger rows.

    A null text counts as empty. Repeated rows and copies get the same findings, from one scan;
    null keys stay; an empty table gives no rows; other columns are not read. The new ledger rows
    are written to the shared folder first, so a lost executor never repeats a finished scan.
    """
    new = settled(update_ledger(docs, ledger, text, rules), "secret-ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    found = blob_findings(whole, rules)
    paths = docs.select(F.col(key), blob_of(text).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    joined = paths.join(found, "blob", "left").select(key, "blob", F.coalesce("findings", none).alias("findings"))
    return joined, whole


def digest(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_<kind> of the base kinds, base_sha256, spans."""
    base = tuple(rule.kind for rule in BASE)

    def number(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings.select(
        key, *map(number, base), F.sha2(_listed("findings", base), 256).alias("base_sha256"), _listed("findings").alias("spans")
    )


def redact(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the secrets of every row replaced; rows without findings are unchanged, all columns stay."""
    new = settled(update_ledger(docs, ledger, text, rules), "secret-ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    named, blob = spare(docs, "_named", "_blob")
    flagged = blob_findings(whole, rules).select(F.col("blob").alias(blob))
    # A value that is long enough may follow a shorter one that the scan dropped; it goes as well.
    # Keys go first: another rule's match inside would hide where they begin or end.
    clean = reduce(
        lambda column, rule: F.regexp_replace(
            column, rule.pattern.replace("]+))", f"]{{{rule.least},}}))") if rule.value else rule.pattern, F.lit(REDACTED)
        ),
        sorted(rules, key=lambda rule: rule.kind != "pem"), F.col(text),
    )
    joined = docs.withColumn(named, blob_of(text)).join(flagged, F.col(named) == F.col(blob), "left")
    return joined.withColumn(text, F.when(F.col(blob).isNotNull(), clean).otherwise(F.col(text))).select(*all_of(docs))
