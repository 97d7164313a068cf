"""Check suggested fixes for regressions without running a parser."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators import lint, scan, structure
from linewright.operators.groups import gather, whole_groups
from linewright.operators.shifts import Shifted
from linewright.operators.spread import running_sum_before
from linewright.session import cut_lineage

FILE = ["review_id", "file_id"]
#: Stands for the repeated imports among the numbers of line rules.
_REPEATED_IMPORT = 1 << 10
_CRITICAL = tuple(rule[0] for rule in fv.LINE_RULES if rule[3] == "critical")


def _bounds(lines: Column) -> tuple[Column, Column]:
    """How many lines stay in front of a fix, and how many lines lie before its end."""
    return F.greatest(F.lit(0), F.col("line_start") - 1), F.least(F.size(lines), F.col("line_end"))


def splice(lines: Column, fix: Column) -> Column:
    """The lines of a file once a finding's lines are replaced by its fix."""
    front, end = _bounds(lines)
    return F.concat(
        F.slice(lines, F.lit(1), front),
        text.split_lines(fix),
        F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))),
    )


def with_content(findings: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """Findings that suggest a fix, next to the content they apply to."""
    wanted = findings.where(F.coalesce("suggested_fix", F.lit("")) != "")
    return wanted.join(files.select(*FILE, "language", "content"), FILE, how)


def apply_fix(findings: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """Adds ``fixed_content``."""
    lines = text.split_lines(F.col("content"))
    return with_content(findings, files, how).withColumn(
        "fixed_content", F.array_join(splice(lines, F.col("suggested_fix")), "\n")
    )


def _sized(files: DataFrame) -> DataFrame:
    """Narrow row per file: language, number of lines, and open less closing brackets per kind."""
    content = F.col("content")
    return files.select(
        *FILE, "language", text.line_count(content).alias("_n"), F.array(*_balances(content)).alias("_total")
    )


def _balances(line: Column) -> list[Column]:
    """Opening less closing brackets of each kind."""
    def count(char: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))

    return [(count(a) - count(b)).cast("long") for a, b in ("()", "[]", "{}")]


def _placed(findings: DataFrame, sized: DataFrame, how: str) -> DataFrame:
    """Findings that suggest a fix: lines kept in front, lines gone by its end, lines it brings."""
    wanted = findings.where(F.coalesce("suggested_fix", F.lit("")) != "")
    # Written once: every check asks for these rows several times.
    return cut_lineage(
        wanted.join(sized, FILE, how)
        .withColumn("_front", F.least(F.greatest(F.lit(0), F.col("line_start") - 1), F.col("_n")))
        .withColumn("_end", F.least(F.col("_n"), F.col("line_end")))
        .withColumn("_size", text.line_count(F.col("suggested_fix"))),
        "placed",
    )


def _line_facts(files: DataFrame, numbers=None, brackets: bool = True) -> DataFrame:
    """``FILE, line_no, rules, brackets`` of lines on which a rule fires or brackets do not pair.

    The one pass over the lines of the files; all checks read what it wrote.
    """
    lines = scan.explode_lines(files, *FILE, "language").withColumn("bare", lint.stripped(F.col("line")))
    none = F.expr("array()").cast("array<int>")
    fired = none if numbers is None else numbers(F.col("line"), F.col("bare"), F.col("language"))
    # Most lines hold no bracket; finding that out is six byte searches.
    held = scan.has_literals(F.col("line"), (tuple("()[]{}"),))
    parsed = F.col("language").isin(*fv.PARSED_LANGUAGES) & F.lit(brackets) & held
    facts = lines.select(
        *FILE, F.col("line_no").cast("int").alias("line_no"), fired.alias("rules"),
        F.when(parsed, F.array(*_balances(F.col("line")))).alias("brackets"),
    )
    told = (F.size("rules") > 0) | F.coalesce(F.exists("brackets", lambda d: d != 0), F.lit(False))
    return cut_lineage(facts.where(told), "line-facts")


def _hits(facts: DataFrame) -> DataFrame:
    return facts.select(*FILE, "line_no", F.explode("rules").alias("rule"))


def _unbalanced(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """``FILE, ord`` of fixes after which brackets are further from balance.

    What a fix takes away is a difference of two running sums over the lines that hold
    brackets, so no fix reads its file again.
    """
    parsed = placed.where(F.col("language").isin(*fv.PARSED_LANGUAGES))
    steps = facts.select(
        *FILE, F.col("line_no").alias("_line"), F.posexplode("brackets").alias("_kind", "_d")
    ).where("_d <> 0")
    # A running sum before line x + 1 covers the lines up to x.
    asked = parsed.select(*FILE, F.explode(F.array("_front", "_end")).alias("_at")).distinct().select(
        *FILE, (F.col("_at") + 1).cast("int").alias("_line"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_kind"),
        F.lit(0).cast("long").alias("_d"),
    )
    points = steps.unionByName(asked).groupBy(*FILE, "_kind", "_line").agg(F.sum("_d").alias("_d"))
    sums = running_sum_before(points, [*FILE, "_kind"], "_line", "_d", "_sum")
    upto = (
        sums.groupBy(*FILE, (F.col("_line") - 1).alias("_at"))
        .agg(F.array_sort(F.collect_list(F.struct("_kind", "_sum")))["_sum"].alias("_sums"))
    )

    def at(name: str) -> DataFrame:
        return upto.select(*FILE, F.col("_at").alias(f"_{name}"), F.col("_sums").alias(f"_sums_{name}"))

    # By sort: hashed, the lists of sums of all files are many times what Spark takes them for.
    both = parsed.join(at("front").hint("merge"), [*FILE, "_front"]).join(at("end").hint("merge"), [*FILE, "_end"])
    fix = F.array(*_balances(F.col("suggested_fix")))
    before = sum((F.abs(F.col("_total")[k]) for k in range(3)), F.lit(0))
    after = sum(
        (F.abs(F.col("_sums_front")[k] + fix[k] + F.col("_total")[k] - F.col("_sums_end")[k]) for k in range(3)), F.lit(0)
    )
    return both.where(after > before).select(*FILE, "ord")


def _new_hits(placed: DataFrame, hits: DataFrame, numbers) -> DataFrame:
    """``FILE, ord`` of fixes with a hit afterwards that was not there before, by rule and line.

    Lines in front keep their hits. Lines of the fix are tested alone. Lines behind take
    theirs along to shifted numbers, and a shift is the same for all fixes of a file that
    change its length alike: per file and shift the last hit that lands where none was
    decides, and it counts for each fix that ends above it. After a shift downwards the
    file's last hit is always such a one; upwards it is searched for.
    """
    line = F.struct(F.col("_text").alias("line"), lint.stripped(F.col("_text")).alias("bare"))
    fresh = (
        placed.where("language IS NOT NULL")
        .select(*FILE, "ord", "language", "_front", F.posexplode(text.split_lines(F.col("suggested_fix"))).alias("_i", "_text"))
        .withColumn("_l", line)
        .select(
            *FILE, "ord", (F.col("_front") + F.col("_i") + 1).cast("int").alias("line_no"),
            F.explode(numbers(F.col("_l.line"), F.col("_l.bare"), F.col("language"))).alias("rule"),
        )
        .join(hits, [*FILE, "line_no", "rule"], "left_anti")
        .select(*FILE, "ord")
    )
    return fresh.unionByName(_moved_hits(placed, hits))


def _shift() -> Column:
    """By how many lines a fix moves what lies behind it."""
    return F.col("_front") + F.col("_size") - F.col("_end")


def _moved_hits(placed: DataFrame, hits: DataFrame) -> DataFrame:
    """``FILE, ord`` of fixes that move a hit to a line where that rule had none."""
    moving = placed.withColumn("_shift", _shift()).where("_shift <> 0")
    last = hits.groupBy(*FILE).agg(F.max("line_no").alias("_last"))
    down = moving.where("_shift > 0").join(last, FILE).where("_last > _end").select(*FILE, "ord")
    up = moving.where("_shift < 0")
    asked = up.groupBy(*FILE, "_shift").agg(F.min("_end").alias("_floor"))
    none = F.lit(None).cast("int")
    told = hits.join(asked.select(*FILE).distinct(), FILE, "left_semi").select(
        *[F.col(c).cast("long") for c in FILE], F.col("rule").cast("int").alias("rule"), F.col("line_no").cast("int").alias("line"),
        none.alias("up"), none.alias("floor"),
    ).unionByName(
        asked.select(
            *[F.col(c).cast("long") for c in FILE], F.lit(-1).alias("rule"), F.lit(0).alias("line"),
            (-F.col("_shift")).cast("int").alias("up"), F.col("_floor").cast("int").alias("floor"),
        )
    )
    landed = gather(told, FILE, "rule", "line").mapInArrow(
        _last_misses, "review_id long, file_id long, _up int, _last int"
    )
    moved = (
        up.withColumn("_up", -F.col("_shift")).join(landed, [*FILE, "_up"]).where("_last > _end").select(*FILE, "ord")
    )
    return down.unionByName(moved)


def _last_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file and distance, the last hit that lands on a line without that rule's hit.

    A file's hits and distances come together, numbers only. Each distance is settled by searches in
    the sums over the hits, never by going through the hits.
    """
    for table, bounds in whole_groups(batches, FILE):
        columns = {c: table.column(c).to_numpy() for c in ("rule", "line")}
        for a, b in bounds:
            rules, lines = columns["rule"][a:b], columns["line"][a:b]
            asked = int((rules == -1).sum())
            edges = [asked, *(asked + 1 + i for i in range(len(rules) - asked - 1) if rules[asked + i] != rules[asked + i + 1]), b - a]
            by_rule = [Shifted(lines[x:y].tolist()) for x, y in zip(edges, edges[1:]) if y > x]
            up, floor = (table.column(c).slice(a, asked).to_pylist() for c in ("up", "floor"))
            found = []
            for distance, lowest in zip(up, floor):
                best = None
                for hits in by_rule:
                    miss = hits.last_miss(distance, lowest if best is None else best)
                    best = best if miss is None else miss
                if best is not None:
                    found.append((distance, best))
            if found:
                key = [table.column(c)[a].as_py() for c in FILE]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([k] * len(found), pa.int64()) for k in key],
                        pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                    ],
                    names=[*FILE, "_up", "_last"],
                )


def _repeated_imports(placed: DataFrame, files: DataFrame) -> DataFrame:
    """``FILE, ord`` of fixes after which an import repeats a module on a line where none did before.

    The imports of the fixed file are those in front, those of the fix and those behind. A module's first
    place settles most of it: an import of the fix repeats one that has its first place in front, or
    an earlier one of the fix; a first place behind becomes a repeat if the fix imports the module. Repeats
    behind move like other hits, except where the fix takes a first place away, which can
    end them; only such fixes look at the imports behind them one by one.
    """
    script = placed.where(lint.is_linted(F.col("language")))
    columns = [*FILE, F.col("line_no").cast("int").alias("line_no"), "part", "source"]
    known = cut_lineage(structure.imports(files.where(lint.is_linted(F.col("language")))).select(*columns), "imports")
    module, place = [*FILE, "source"], F.struct("line_no", "part")
    # The module's places in a file, as runs of one line behind the other: bounded by the file.
    before = Window.partitionBy(*module).orderBy("line_no", "part")
    chained = known.withColumn("_previous", F.lag("line_no").over(before))
    firsts = known.groupBy(*module).agg(F.min(place)["line_no"].alias("_first"))
    repeats = chained.where("_previous IS NOT NULL").select(*FILE, "line_no").distinct()
    brought = structure.imports(
        script.select(*FILE, F.col("ord").cast("string").alias("filename"), "language", F.col("suggested_fix").alias("content"))
    ).select(*FILE, F.col("filename").cast("long").alias("ord"), "source", F.col("line_no").alias("_i"), "part")
    earlier = Window.partitionBy(*FILE, "ord", "source").orderBy("_i", "part")
    brought = cut_lineage(
        brought.withColumn("_n", F.row_number().over(earlier))
        .join(script.select(*FILE, "ord", "_front", "_end", _shift().alias("_shift")), [*FILE, "ord"])
        .join(firsts, module, "left"),
        "fix-imports",
    )

    def at(rows: DataFrame, line: Column) -> DataFrame:
        landed = rows.select(*FILE, "ord", line.cast("int").alias("line_no"))
        return landed.join(repeats, [*FILE, "line_no"], "left_anti").select(*FILE, "ord")

    own = at(brought.where((F.col("_n") > 1) | (F.col("_first") <= F.col("_front"))), F.col("_front") + F.col("_i"))
    met = at(brought.where(F.col("_first") > F.col("_end")), F.col("_first") + F.col("_shift"))

    # Fixes that take away the first place of a module with others.
    heads = firsts.join(chained.where("_previous IS NOT NULL").select(*module).distinct(), module).select(
        *FILE, F.col("_first").alias("_taken")
    ).distinct()
    spans = script.where("_end > _front").withColumn("_taken", F.explode(F.sequence(F.col("_front") + 1, F.col("_end"))))
    taking = spans.join(heads, [*FILE, "_taken"], "left_semi").select(*FILE, "ord").distinct()
    plain = script.join(taking, [*FILE, "ord"], "left_anti")
    moved = _moved_hits(plain, repeats.withColumn("rule", F.lit(_REPEATED_IMPORT)))
    fix_has = brought.select(*FILE, "ord", "source").distinct().withColumn("_has", F.lit(True))
    behind = (
        script.join(taking, [*FILE, "ord"]).withColumn("_shift", _shift()).where("_shift <> 0")
        .select(*FILE, "ord", "_front", "_end", "_shift")
        .join(chained, FILE).where(F.col("line_no") > F.col("_end"))
        .join(firsts, module)
        .join(fix_has, [*FILE, "ord", "source"], "left")
        .where((F.col("_first") <= F.col("_front")) | F.col("_has") | (F.col("_previous") > F.col("_end")))
    )
    return own.unionByName(met).unionByName(moved).unionByName(at(behind, F.col("line_no") + F.col("_shift")))


def _with_regressed(placed: DataFrame, bad: DataFrame) -> DataFrame:
    marks = bad.distinct().withColumn("_bad", F.lit(True))
    return placed.join(marks, [*FILE, "ord"], "left").withColumn("regressed", F.coalesce("_bad", F.lit(False))).drop(
        "_n", "_total", "_front", "_end", "_size", "_bad"
    )


def syntax_check(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``regressed``: brackets are further from balance; only where a grammar is known."""
    placed = _placed(findings, _sized(files), "inner")
    return _with_regressed(placed, _unbalanced(placed, _line_facts(files)))


def _catalogue_numbers(line: Column, *_) -> Column:
    return scan.rule_numbers(line, _CRITICAL)


def _error_numbers(line: Column, bare: Column, language: Column) -> Column:
    return lint.rule_numbers(line, bare, language, "error")


def pattern_check(findings: DataFrame, files: DataFrame) -> DataFrame:
    """New critical hits of the rule catalogue; a fix that changes the number of lines
    moves old hits, which then count as new."""
    placed = _placed(findings, _sized(files), "inner")
    hits = _hits(_line_facts(files, _catalogue_numbers, brackets=False))
    return _with_regressed(placed, _new_hits(placed, hits, _catalogue_numbers))


def lint_check(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The same for the rules of lint at error level, in script files: line rules and repeated imports."""
    script = files.where(lint.is_linted(F.col("language")))
    placed = _placed(findings, _sized(script), "inner")
    hits = _hits(_line_facts(script, _error_numbers, brackets=False))
    bad = _new_hits(placed, hits, _error_numbers).unionByName(_repeated_imports(placed, script))
    return _with_regressed(placed, bad)


def fix_status(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``fix_status``.

    No fix or any regression is ``unavailable``, all checks passed is ``verified``, and a
    fix whose file is missing cannot be checked and stays ``unverified``. ``ord`` tells the
    findings of a file apart. Contents are read where their lines are tested; joins see
    line numbers, rules and bracket counts only.
    """
    has_fix = F.coalesce("suggested_fix", F.lit("")) != ""
    # Written once: findings with a fix and those without go different ways, and they often come
    # straight out of a pass over all lines.
    findings = cut_lineage(findings.drop("fix_status"), "findings")
    idle = findings.where(~has_fix).withColumn("fix_status", F.lit("unavailable"))

    def numbers(line, bare, language):
        """Critical catalogue rules as they are, lint errors behind them."""
        shift = len(fv.LINE_RULES)
        errors = F.transform(_error_numbers(line, bare, language), lambda n: n + shift)
        none = F.expr("array()").cast("array<int>")
        return F.concat(_catalogue_numbers(line), F.when(lint.is_linted(language), errors).otherwise(none))

    keep = findings.columns
    placed = _placed(findings, _sized(files), "left")
    known = placed.where("language IS NOT NULL")
    facts = _line_facts(files, numbers)
    bad = _unbalanced(known, facts).unionByName(_new_hits(known, _hits(facts), numbers)).unionByName(_repeated_imports(known, files))
    status = (
        F.when(F.col("language").isNull(), "unverified")
        .when(F.col("regressed"), "unavailable")
        .otherwise("verified")
    )
    return _with_regressed(placed, bad).withColumn("fix_status", status).select(*keep, "fix_status").unionByName(
        idle.select(*keep, "fix_status")
    )
