"""Secret scans through an incremental blob ledger, with DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger remembers which (blob, rule
version) pairs have been scanned and what was found; a run scans unseen pairs only, once for each blob however
many paths carry it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, count if group ``group`` has ``least`` characters.

    ``hints``: every match contains one of these strings, so that a text without them needs no pattern search.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...]


# The patterns and least lengths of the base kinds.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    # a run of 24 and more is what is left of all runs
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, ()),
)
# A private key from its BEGIN line to its END line, however the lines between are quoted, headers among them (their dashes
# are all that is counted, so that no engine recurses over a long text). Without an END line, or beyond 64 dashes: headers
# and runs of base64 as long as a key's lines, wherever they are broken, with a last shorter run; or whole lines of base64.
_GAP, _LINES = r"[\x20\t\r\n]+", r"[A-Za-z0-9+/=\\\r\n]*(?m:$)"
_RUN = "[A-Za-z0-9+/=]" * 24 + "[A-Za-z0-9+/=]*"  # spelled out: engines limit the product of nested counts
_HEADERS = r"(?:[\x20\t\r\n]*[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n]*){0,16}"
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|{_HEADERS}(?:{_GAP}{_RUN}){{1,300}}(?:{_LINES})?(?:{_GAP}[A-Za-z0-9+/=]+(?m:$))?|{_LINES})?"
)
EXTRA_RULES = (
    Rule("pem", 2, _KEY, 0, 1, ("PRIVATE KEY",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + EXTRA_RULES
SPAN = "array<struct<start:int,end:int,kind:string>>"
NO_SPANS = f"cast(array() as {SPAN})"


def _hinted(text: Column, rule: Rule) -> Column:
    found = F.lit(not rule.hints)
    for hint in rule.hints:
        found = found | F.contains(text, F.lit(hint))
    return found


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text: code points, end exclusive.

    Splitting at the matches gives the gap in front of each; lengths of gaps and matches add up to the places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.zip_with(F.split(text, rule.pattern, -1), matches, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    if rule.group:
        counted = F.zip_with(parts, F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda p, g: F.struct(p.gap, p.hit, F.length(g).alias("counted")))
    else:
        counted = F.transform(parts, lambda p: F.struct(p.gap, p.hit, p.hit.alias("counted")))
    # the last part is the gap behind the last match: its hit is null
    kept = F.aggregate(
        counted,
        F.expr(f"struct(0 as at, {NO_SPANS} as found)"),
        lambda state, p: F.struct(
            (state.at + p.gap + F.coalesce(p.hit, F.lit(0))).alias("at"),
            F.when(
                p.counted >= rule.least,
                F.concat(
                    state.found,
                    F.array(F.struct((state.at + p.gap).alias("start"), (state.at + p.gap + p.hit).alias("end"), F.lit(rule.kind).alias("kind"))),
                ),
            ).otherwise(state.found).alias("found"),
        ),
        lambda state: state.found,
    )
    return F.when(_hinted(text, rule) & text.rlike(rule.pattern), kept).otherwise(F.expr(NO_SPANS))


def rule_versions(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """Each version with the address of its content; null content is empty content."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return versions.withColumn("blob_id", F.sha2(content, 256))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """New ledger rows (blob_id, kind, version, spans) for the (blob, rule version) pairs not in ``ledger``.

    ``spans`` is empty where nothing was found, which is how the ledger knows that the pair is done. A blob on
    many paths is scanned once: copies meet in a partial aggregation before the shuffle. An empty table gives no
    rows. A rule with a new version number is unseen for every blob.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("blob_id"), content.alias("content")).groupBy("blob_id").agg(F.first("content").alias("content"))
    if ledger is None:
        wanted = {r: F.lit(True) for r in rules}
    else:
        done = ledger.groupBy("blob_id").agg(F.collect_set(F.struct("kind", "version")).alias("done"))  # bounded by the rules
        blobs = blobs.join(done, "blob_id", "left")
        wanted = {r: ~F.coalesce(F.array_contains("done", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(False)) for r in rules}
    found = F.array(*[
        F.when(wanted[r], F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("content"), r).alias("spans")))
        for r in rules
    ])
    return blobs.select("blob_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("row")).select("blob_id", "row.*")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every version with the blob's spans under the given rules, sorted by start, then in the rules' order.

    The ledger is brought to one row for each blob that has findings before it meets the paths; the side of the
    paths, where one blob may hold a third of the rows, is an outer join's left side, which adaptive execution
    splits. A version without findings keeps an empty list.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array_contains(rule_versions(rules), F.struct("kind", "version"))
    per_blob = (
        ledger.where(current & (F.size("spans") > 0)).select("blob_id", F.explode("spans").alias("s"))
        .groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("s.start", order[F.col("s.kind")].alias("rank"), "s.end", "s.kind"))).alias("spans"))
    )
    return addressed(versions, text).join(per_blob, "blob_id", "left").withColumn(
        "spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"))
    )


def number(kind: str) -> Column:
    """How many spans of a kind a version has."""
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def digest(kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of the given kinds alone if named."""
    chosen = F.col("spans") if kinds is None else F.filter("spans", lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def masked(text: Column, rule: Rule, mask: str = "[SECRET]") -> Column:
    """The text with each counted match of the rule replaced, in time linear in the text."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    shown = F.zip_with(matches, groups, lambda hit, group: F.when(F.length(group) >= rule.least, F.lit(mask)).otherwise(hit))
    parts = F.zip_with(F.split(text, rule.pattern, -1), shown, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    return F.when(_hinted(text, rule) & text.rlike(rule.pattern), F.array_join(parts, "")).otherwise(text)


def redact(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The versions with their secrets masked, rule after rule; rows and columns stay as they are, whatever their names.

    Whole keys come first: another rule's mask inside of one, or on its BEGIN line, would hide the rest from its rule.
    """
    packed = versions.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    found = findings(packed, ledger, rules).withColumn("clean", F.col("text"))
    # a step each: nested in one expression, the text would be written out many times over
    for rule in sorted(rules, key=lambda r: r.kind != "pem"):
        found = found.withColumn("clean", masked(F.col("clean"), rule))
    return found.select(F.col("row").withField(f"`{text}`", F.when(F.size("spans") > 0, F.col("clean")).otherwise(F.col("text"))).alias("row")).select("row.*")
