"""Checks of written reports: a table of lines (report_id, ln, text) against a
rule dimension. Lines inside code fences are not content; the section of a line
is the last heading above it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import BADGES, badge_key

BADGE = r"\[([A-Za-z][A-Za-z _-]{2,30}|[一-鿿]{2,6})\]"


def _order() -> Window:
    return Window.partitionBy("report_id").orderBy("ln")


def report_lines(reports: DataFrame, text_col: str = "markdown") -> DataFrame:
    return reports.select("report_id", F.posexplode(F.split(text_col, "\r?\n")).alias("ln", "text"))


def content_lines(lines: DataFrame) -> DataFrame:
    """Lines outside fenced code: even number of fences so far."""
    fence = F.startswith(F.ltrim("text"), F.lit("```"))
    marked = lines.withColumn("_f", F.sum(fence.cast("int")).over(_order()))
    return marked.where((F.col("_f") % 2 == 0) & ~fence).drop("_f")


def sections(lines: DataFrame) -> DataFrame:
    """Lines with the heading they stand under."""
    head = F.when(F.col("text").rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace("text", r"^#+\s*", "")))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(_order()))


def claim_segments(lines: DataFrame) -> DataFrame:
    """One row for each badge in a line with its claim: the words since the badge
    before it (or the start of its table cell); a badge without words before it
    claims those that follow."""
    cells = lines.select("report_id", "ln", F.posexplode(F.split("text", r"\|")).alias("cell", "c"))
    marks = cells.withColumn("b", F.regexp_extract_all("c", F.lit(BADGE), F.lit(1))).where(F.size("b") > 0).withColumn("w", F.split("c", BADGE))
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", ""), r"^[ \t>*\-;,.:]+|[ \t>*\-;,.:]+$", ""))
    said = F.transform("b", lambda x, i: F.struct(x.alias("badge"), tidy(F.get("w", i)).alias("before"), F.trim(F.get("w", i + 1)).alias("after")))
    rows = marks.select("report_id", "ln", "cell", F.posexplode(said).alias("at", "s"))
    label = F.regexp_replace(F.lower(F.trim("s.badge")), r"[ -]+", "_")
    claim = F.when(F.col("s.before") != "", F.col("s.before")).otherwise(F.col("s.after"))
    return rows.select("report_id", "ln", (F.col("cell") * 100 + F.col("at")).alias("pos"), badge_key(label).alias("badge"), claim.alias("claim"))


def report_status(lines: DataFrame, pattern: str = r"(?i)^\W*status\W+(complete|partial|failed)\b") -> DataFrame:
    """Declared status where exactly one is declared."""
    hit = F.lower(F.regexp_extract("text", pattern, 1))
    found = lines.select("report_id", F.nullif(hit, F.lit("")).alias("status")).where("status is not null")
    return found.groupBy("report_id").agg(F.countDistinct("status").alias("n"), F.first("status").alias("status")).where("n = 1").select("report_id", "status")


def badge_rule(lines: DataFrame, pattern: str, kind: str, required: tuple[str, ...] = (), forbidden: tuple[str, ...] = (), severity: str = "error") -> DataFrame:
    """Issues of lines that match a pattern and lack a required badge or carry
    a forbidden one."""
    badges = F.transform(F.regexp_extract_all("text", F.lit(BADGE), F.lit(1)), lambda b: badge_key(F.regexp_replace(F.lower(F.trim(b)), r"[ -]+", "_")))
    bad = F.lit(False)
    if required:
        bad = bad | ~F.arrays_overlap(badges, F.array(*[F.lit(b) for b in required]))
    if forbidden:
        bad = bad | F.arrays_overlap(badges, F.array(*[F.lit(b) for b in forbidden]))
    return lines.where(F.col("text").rlike(f"(?i){pattern}") & F.coalesce(bad, F.lit(bool(required)))).select("report_id", "ln", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "text")


@dataclass(frozen=True)
class Profile:
    """What a kind of report must look like. Patterns are regular expressions;
    terms are (pattern, hint)."""

    summary_heading: str = "## Summary"
    appendix_prefix: str = "## Appendix"
    fixed_ending: str = ""
    require_status: bool = True
    inferred_tag: str = "[Inferred]"
    basis: str = r"(?i)\bbasis\b"
    verified: str = "verified"
    explain: str = r"\("
    old_labels: tuple[tuple[str, str], ...] = ()
    tech_terms: tuple[tuple[str, str], ...] = ()
    soft_tech_terms: tuple[tuple[str, str], ...] = ()
    forbidden_terms: tuple[tuple[str, str], ...] = ()
    judgment: str | None = None
    mixed: str | None = None


#: Full-width punctuation, quoted words, addresses.
FULL_WIDTH = "[，。；：！？（）【】]"
QUOTED = "\"[^\"]*\"|“[^”]*”|「[^」]*」"
ADDRESS = r"https?://\S+"


def check_text(lines: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """report_id, ln (0: the report as a whole), kind, severity, text of every
    issue: structure (summary first, appendix, ending, status), old labels,
    inferences without a basis in their line or cell, technical and forbidden
    words before the appendix, verified labels on judgments or mixed sources,
    full-width punctuation (one issue for a report)."""
    p = profile
    content = content_lines(lines)
    head = F.col("text").rlike(r"^##\s")
    trimmed = F.trim("text")
    first = lambda cond: F.min(F.when(cond, F.col("ln")))
    shape = content.groupBy("report_id").agg(
        first(head & (trimmed == p.summary_heading)).alias("summary"), first(head).alias("first_head"), first(head & F.startswith(trimmed, F.lit(p.appendix_prefix))).alias("appendix"),
    )
    ending = lines.groupBy("report_id").agg(F.bool_or(F.contains("text", F.lit(p.fixed_ending))).alias("ended"))
    whole = ending.join(shape, "report_id", "left").join(report_status(content), "report_id", "left")
    issue = lambda cond, kind, severity="error", ln=F.lit(0), text=F.lit(""): F.when(cond, F.struct(ln.cast("int").alias("ln"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), text.alias("text")))
    structure = [
        issue(F.col("summary").isNull(), "no_summary"), issue(F.col("summary") != F.col("first_head"), "summary_not_first", ln=F.col("summary")), issue(F.col("appendix").isNull(), "no_appendix"),
        issue(~F.col("ended"), "no_ending"), issue(F.lit(p.require_status) & F.col("status").isNull(), "no_status"),
    ]
    flat = lambda df, made: df.select("report_id", F.explode(F.array_compact(F.array(*made))).alias("i")).select("report_id", "i.ln", "i.kind", "i.severity", "i.text")
    out = flat(whole, structure)
    rows = content.withColumn("next", F.lead("text").over(_order())).withColumn("next_ln", F.lead("ln").over(_order())).join(shape.select("report_id", "appendix"), "report_id")
    goes_on = (F.col("next_ln") == F.col("ln") + 1) & F.col("next").rlike(r"^[ \t]") & ~F.col("next").rlike(r"^\s*(?:[-*+]|\d+[.)])\s")
    unit = F.concat(F.col("text"), F.when(goes_on, F.col("next")).otherwise(""))
    cells = F.when(F.startswith(F.ltrim(unit), F.lit("|")), F.split(unit, r"\|")).otherwise(F.array(unit))
    guess = F.exists(cells, lambda c: F.contains(c, F.lit(p.inferred_tag)) & ~c.rlike(p.basis)) & F.contains("text", F.lit(p.inferred_tag))
    body = F.col("appendix").isNull() | (F.col("ln") < F.col("appendix"))
    plain = F.regexp_replace("text", ADDRESS, " ")
    bare = F.regexp_replace(plain, QUOTED, '""')
    ln, text = F.col("ln"), F.col("text")
    made = [issue(guess, "guess_no_basis", ln=ln, text=text)]
    made += [issue(F.contains("text", F.lit(old)), "old_label", ln=ln, text=text) for old, _ in p.old_labels]
    for pattern, _ in p.tech_terms:
        made += [issue(body & plain.rlike(pattern) & plain.rlike(p.explain), "tech_term", "warning", ln, text), issue(body & plain.rlike(pattern) & ~plain.rlike(p.explain), "tech_term", ln=ln, text=text)]
    made += [issue(body & bare.rlike(pattern), "soft_tech_term", "warning", ln, text) for pattern, _ in p.soft_tech_terms]
    made += [issue(body & plain.rlike(pattern), "forbidden_term", ln=ln, text=text) for pattern, _ in p.forbidden_terms]
    out = out.unionByName(flat(rows, made))
    claims = claim_segments(rows.where(body & ~F.startswith(F.ltrim("text"), F.lit("#"))).select("report_id", "ln", "text")).where((F.col("badge") == p.verified) & (F.col("claim") != ""))
    said = F.regexp_replace("claim", QUOTED, '""')
    judged = said.rlike(p.judgment) if p.judgment else F.lit(False)
    mixed = said.rlike(p.mixed) if p.mixed else F.lit(False)
    over = [issue(judged, "over_label", "warning", ln, F.col("claim")), issue(~judged & mixed, "mixed_source", "warning", ln, F.col("claim"))]
    out = out.unionByName(flat(claims, over))
    wide = content.where(F.col("text").rlike(FULL_WIDTH)).groupBy("report_id").agg(F.min("ln").cast("int").alias("ln"), F.min_by("text", "ln").alias("text"))
    return out.unionByName(wide.select("report_id", "ln", F.lit("fullwidth").alias("kind"), F.lit("warning").alias("severity"), "text"))


def whole_numbers(text: Column) -> Column:
    """Counts in prose; prices, percents, dates and decimals are left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.,$€£¥-])(\d{1,3}(?:,\d{3})+|\d+)(?![\d.,]*\d|\s?%|[-/]\d)"), F.lit(1))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).cast("long"))


def count_mismatches(lines: DataFrame, summary: DataFrame, pattern: str, count_col: str) -> DataFrame:
    """Lines about a measure whose numbers do not include the summary's count."""
    hits = content_lines(lines).where(F.col("text").rlike(f"(?i){pattern}")).withColumn("n", whole_numbers(F.col("text"))).where(F.size("n") > 0)
    return hits.join(summary.select("report_id", F.col(count_col).cast("long").alias("_c")), "report_id").where(~F.array_contains("n", F.col("_c"))).select("report_id", "ln", "text", F.col("_c").alias("expected"))


def badge_counts(lines: DataFrame) -> DataFrame:
    """Badges of each report, zeros included."""
    n = claim_segments(content_lines(lines)).groupBy("report_id", "badge").agg(F.count(F.lit(1)).alias("n"))
    spine = lines.select("report_id").distinct().withColumn("badge", F.explode(F.array(*[F.lit(b) for b, _ in BADGES])))
    return spine.join(n, ["report_id", "badge"], "left").select("report_id", "badge", F.coalesce("n", F.lit(0)).alias("n"))
