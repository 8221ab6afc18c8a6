"""Mutation and coverage reports: code locations, covering tests and generalizations, status changes, and what a generalized suite changes.

Column names are those of the report tables: mutation reports have id, project_id, variant, status, is_detected, mutator,
the location columns, blocks (a JSON array of block numbers) and killing ids; coverage reports have id, project_id,
variant, the location columns, block, and a test_id or generalization_id. A null variant is the run without one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import bucketed
from .ids import global_dense_id

#: Where code is, without its block.
PLACE = ["package_name", "class_name", "method_name", "method_description"]
LOCATION = [*PLACE, "block"]


def blocks_of(reports: DataFrame) -> DataFrame:
    """One row for each block of each mutation report; a report without blocks gives none."""
    return reports.withColumn("block", F.explode(F.from_json("blocks", "array<int>")))


def locations(coverage: DataFrame, mutations: DataFrame) -> DataFrame:
    """(location_id, *LOCATION): every location of either kind of report, numbered by its columns' order."""
    every = coverage.select(*LOCATION).union(blocks_of(mutations).select(*LOCATION)).distinct()
    return global_dense_id(every, LOCATION, "location_id")


def located(rows: DataFrame, places: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, location_id) of report rows by their five location columns; null where a location is unknown or has a null part."""
    return rows.select(*keep, *LOCATION).join(places, LOCATION, "left").select(*keep, "location_id")


def location_lists(mutations: DataFrame, places: DataFrame) -> DataFrame:
    """(id, location_ids): sorted lists, [] for reports without blocks."""
    listed = located(blocks_of(mutations), places, ["id"]).groupBy("id").agg(F.array_sort(F.collect_list("location_id")).alias("location_ids"))
    return mutations.select("id").join(listed, "id", "left").withColumn("location_ids", F.coalesce("location_ids", F.array().cast("array<bigint>")))


def mutation_ids(mutations: DataFrame, identity: list[str]) -> DataFrame:
    """Reports with mutation_id, the same for one mutant in every run."""
    return global_dense_id(mutations, identity, "mutation_id")


def meetings(sites: DataFrame, coverage: DataFrame, at: list[str]) -> DataFrame:
    """Each pair of a site (*at, blocks, id) and a coverage report (*at, block, and whatever tells its id) that meet in a block of the site.

    A mutation report stands once among the sites and a coverage report once in the coverage, so that no pair comes twice: pairs leave the task of their
    place as they are, and only sites and coverage are shuffled.
    """
    asked = sites.withColumn("block", F.explode(F.array_distinct("blocks"))).drop("blocks")
    return asked.hint("shuffle_hash").join(coverage, [*at, "block"])


def covering(sites: DataFrame, footprints: DataFrame, at: list[str], keep: list[str | Column] = ()) -> DataFrame:
    """(mutation_id, *at, *keep, the entity's columns): each pair of a site (*at, blocks, id, and more) and an entity's footprint (*at, blocks, and its columns) that share a block; mutation_id is the site's id.

    A footprint is an entity's one row for a place and run, with all the blocks that it covers there (an array). So an entity
    meets a site once, whatever blocks they share, and pairs are neither shuffled nor compared.
    """
    own = [c for c in footprints.columns if c not in (*at, "blocks")]
    asked = sites.select(*at, F.col("blocks").alias("_asked"), F.col("id").alias("mutation_id"), *keep)
    return asked.hint("shuffle_hash").join(footprints, at).filter(F.arrays_overlap("_asked", "blocks")).select(*[c for c in asked.columns if c != "_asked"], *own)


def covered_sums(sites: DataFrame, footprints: DataFrame, at: list[str], weights: list[str]) -> DataFrame:
    """Sites (*at, blocks, id, and more) with the sums of the weights over the footprints that share a block with them, 0 where none does.

    Footprints (*at, blocks, *weights) of one place that cover the same blocks are summed before they meet sites, so that neither sites nor
    entities are paired. A null weight is 0.
    """
    alike = footprints.groupBy(*at, "blocks").agg(*[F.sum(w).alias(w) for w in weights])
    alike = alike.select(*[F.col(c).alias(f"_{c}") for c in [*at, "blocks"]], *weights)
    meets = reduce(lambda x, c: x & (F.col(c) == F.col(f"_{c}")), at, F.arrays_overlap("blocks", "_blocks"))
    return sites.join(alike, meets, "left").groupBy(*at, *[c for c in sites.columns if c not in at]).agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in weights])


def covered_reports(mutations: DataFrame, coverage: DataFrame) -> DataFrame:
    """(mutation_id): the reports that mutation_coverage() would pair with any coverage, without the pairs. A report stands once for each block that meets some; both have project_id, run and the location columns."""
    keys = ["project_id", "run", *LOCATION]
    return blocks_of(mutations).select(*keys, F.col("id").alias("mutation_id")).join(coverage.select(*keys), keys, "left_semi").select("mutation_id")


def detection_comparison(mutations: DataFrame, group: list[str], relations: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """(*group, count, avg_<v> and median_<v> of each value) over the product of several left joins, without making it.

    ``mutations`` have id and the group columns; each relation is (rows with mutation_id, its value columns). In the product
    a row of one relation stands as often as the mutant has rows in the others (once, if none), so that this number is its
    weight in means and exact medians. Mutants without rows count in ``count`` alone. Relations are read once for their numbers
    and once for each value, so they are written in buckets of the mutants.
    """
    relations = [(bucketed(rows.select("mutation_id", *values), "mutation_id"), values) for rows, values in relations]
    sized = mutations.select("id", *group)
    for i, (rows, _) in enumerate(relations):
        sized = sized.join(rows.groupBy(F.col("mutation_id").alias("id")).agg(F.count("*").alias(f"n{i}")), "id", "left").withColumn(f"n{i}", F.coalesce(f"n{i}", F.lit(0)))
    sized = bucketed(sized, "id")
    weighed = lambda i: sized.select(F.col("id").alias("mutation_id"), *group, product_weight(i, len(relations)).alias("_w")).join(relations[i][0], "mutation_id")
    return compared(sized, group, [(weighed(i), values) for i, (_, values) in enumerate(relations)])


def product_weight(i: int, relations: int) -> Column:
    """How often a row of relation i stands in the product of a mutant's relations, whose rows number n0, n1, ...: a relation without rows gives one."""
    return reduce(lambda x, j: x * F.greatest(F.col(f"n{j}"), F.lit(1)), [j for j in range(relations) if j != i], F.lit(1).cast("long"))


def compared(mutations: DataFrame, group: list[str], weighed: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """(*group, count, avg_<v> and median_<v>) of mutations (id, *group) and of rows (*group, _w, values), each with its value columns. Each frame is read once."""
    out = mutations.groupBy(*group).agg(F.countDistinct("id").alias("count"))
    for rows, values in weighed:
        # One row for each different value, so that a group's median reads values, not rows.
        each = F.array(*[F.struct(F.lit(v).alias("_v"), F.col(v).cast("double").alias("_x")) for v in values])
        spread = rows.groupBy(*group, *values).agg(F.sum("_w").alias("_w")).select(*group, "_w", F.inline(each)).filter("_x is not null").groupBy(*group, "_v", "_x").agg(F.sum("_w").alias("_w"))
        stats = spread.groupBy(*group, "_v").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_avg"), F.expr("percentile(_x, 0.5, _w)").alias("_median"))
        of = lambda v, c: F.max(F.when(F.col("_v") == v, F.col(c)))
        out = out.join(stats.groupBy(*group).agg(*[of(v, f"_{kind}").alias(f"{kind}_{v}") for v in values for kind in ("avg", "median")]), group, "left")
    return out


def status_changes(reports: DataFrame, first: list[str], never: str) -> DataFrame:
    """Pairs of a mutant's reports of which the earlier is one of the runs ``first``, the later not ``never``, and the statuses differ.

    Reports have mutation_id and variant_name. Columns: project_id, and id, variant, status and is_detected of both as a_… and b_…, and the later
    report's killing ids.
    """
    named = ["id", "status", "is_detected"]
    a = reports.filter(F.col("variant_name").isin(first)).select("project_id", "mutation_id", F.col("variant_name").alias("a_variant"), *[F.col(c).alias(f"a_{c}") for c in named])
    b = reports.filter(F.col("variant_name") != never).select("mutation_id", F.col("variant_name").alias("b_variant"), *[F.col(c).alias(f"b_{c}") for c in named], "killing_test_id", "killing_generalization_id")
    return a.join(b, "mutation_id").filter("a_variant <> b_variant and a_status <> b_status").drop("mutation_id")


def with_found(rows: DataFrame, found: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Left join by a key that most rows lack: those meet nothing, and are dealt by the columns ``spread``, not all to the one task of null."""
    dealt = rows.withColumn("_dealt", F.coalesce(key, F.xxhash64(*spread))).alias("r")
    meets = (F.col("r._dealt") == F.col(f"f.{key}")) & F.col(f"r.{key}").isNotNull()
    return dealt.join(found.alias("f"), meets, "left").select("r.*", *[F.col(f"f.{c}") for c in found.columns if c != key]).drop("_dealt")


def killing_entities(changes: DataFrame, tests: DataFrame, generalizations: DataFrame, reports: DataFrame) -> DataFrame:
    """Status changes with the killing test, assertion and generalization, its lines, and the runtime of each of its test reports.

    A generalization with several test reports gives a row for each, as many runs were measured.
    """
    g = generalizations.select(F.col("id").alias("killing_generalization_id"), F.col("test_id").alias("_test"), F.col("assertion_id").alias("killing_assertion_id"), F.col("line_count").alias("killing_line_count"))
    runs = reports.filter("generalization_id is not null").select(F.col("generalization_id").alias("killing_generalization_id"), F.col("runtime").alias("killing_runtime"))
    known = tests.select(F.col("id").alias("killing_test_id"), F.lit(True).alias("_known"))
    out = changes
    for found, key in ((g, "killing_generalization_id"), (runs, "killing_generalization_id"), (known, "killing_test_id")):
        out = with_found(out, found, key, ["a_id", "b_id"])
    return out.withColumn("killing_test_id", F.coalesce("_test", F.when(F.col("_known"), F.col("killing_test_id")))).drop("_test", "_known")


def _changed(name: str, before: Column, added: Column, removed: Column) -> list[Column]:
    after = before + added - removed
    pct = F.round(F.try_divide((added - removed) * 100.0, before), 2)
    return [before.alias(f"{name}_before"), added.alias(f"added_{name}"), removed.alias(f"removed_{name}"), after.alias(f"{name}_after"), (added - removed).alias(f"{name}_delta"), pct.alias(f"{name}_delta_pct")]


def generalization_effects(changes: DataFrame, generalizations: DataFrame, assertions: DataFrame, tests: DataFrame, runtimes: DataFrame, generalization_runtimes: DataFrame) -> DataFrame:
    """Per project and pair of runs: newly killed mutants, and tests, lines and runtime before and after the killing generalizations are added and replaceable tests removed.

    A test is replaceable if every one of its assertions is represented by a killing generalization. changes: rows of
    killing_entities(); runtimes: (test_id, variant, runtime) of tests by run; generalization_runtimes: (generalization_id, runtime).
    Copies of a change by several runtimes count, as they do in the changes.
    """
    pair = ["project_id", "a_variant", "b_variant"]
    killed = changes.filter("not a_is_detected and b_status = 'KILLED'")
    base = killed.groupBy(*pair).agg(F.count("*").alias("killed_mutations"))
    g = generalizations.select(F.col("id").alias("killing_generalization_id"), F.col("test_id"), F.col("assertion_id"), F.col("line_count").alias("_lines"))
    spent = generalization_runtimes.select(F.col("generalization_id").alias("killing_generalization_id"), F.col("runtime").alias("_time"))
    killing = killed.select(*pair, "killing_generalization_id").distinct().join(g, "killing_generalization_id").join(spent, "killing_generalization_id")
    added = killing.groupBy(*pair).agg(F.count("*").alias("_added"), F.sum("_lines").alias("_added_lines"), F.sum("_time").alias("_added_time"))
    represented = killing.select(*pair, "test_id", "assertion_id").distinct().groupBy(*pair, "test_id").agg(F.count("*").alias("_represented"))
    whole = assertions.groupBy("test_id").agg(F.count("*").alias("_assertions"))
    of_test = tests.select(F.col("id").alias("test_id"), "line_count")
    replaced = represented.join(whole, "test_id").filter("_represented = _assertions").join(of_test, "test_id").join(runtimes.withColumnRenamed("variant", "a_variant"), ["test_id", "a_variant"])
    removed = replaced.groupBy(*pair).agg(F.count("*").alias("_removed"), F.sum("line_count").alias("_removed_lines"), F.sum("runtime").alias("_removed_time"))
    original = runtimes.filter("variant = 'ORIGINAL'").join(tests.select(F.col("id").alias("test_id"), "project_id", "line_count"), "test_id")
    totals = original.groupBy("project_id").agg(F.count("*").alias("_tests"), F.sum("line_count").alias("_lines"), F.sum("runtime").alias("_time"))
    joined = base.join(added, pair, "left").join(removed, pair, "left").fillna(0, ["_added", "_removed", "_removed_lines", "_removed_time"]).join(totals, "project_id")
    c = F.col
    return joined.select(*pair, "killed_mutations", *_changed("tests", c("_tests"), c("_added"), c("_removed")), *_changed("lines", c("_lines"), c("_added_lines"), c("_removed_lines")), *_changed("runtime", c("_time"), c("_added_time"), c("_removed_time")))


def kill_gain(reports: DataFrame, key: list[str], variant: str, detected: str, before: str, after: str) -> DataFrame:
    """(project_id, killed_before, killed_after, gained, lost): distinct mutants that one run detects and the other does not, by key sets."""
    found = reports.filter(F.col(detected)).filter(F.col(variant).isin(before, after)).groupBy("project_id", *key).agg(F.bool_or(F.col(variant) == before).alias("_b"), F.bool_or(F.col(variant) == after).alias("_a"))
    return found.groupBy("project_id").agg(F.count_if("_b").alias("killed_before"), F.count_if("_a").alias("killed_after"), F.count_if(~F.col("_b") & F.col("_a")).alias("gained"), F.count_if(F.col("_b") & ~F.col("_a")).alias("lost"))


def paired_gain(reports: DataFrame, key: list[str], variant: str, status: str, before: str, after: str) -> DataFrame:
    """One row a project: mutants paired over two runs by a composite key (nulls equal), those in one run only, covered ones, and those that only the later run kills.

    An unpaired mutant is counted and is part of no other figure but ``mutants``.
    """
    one = F.struct(*key).alias("_mutant")
    sides = [reports.filter(F.col(variant) == v).select("project_id", one, F.col(status).alias(f"_{n}")).distinct() for n, v in (("b", before), ("a", after))]
    both = sides[0].join(sides[1], ["project_id", "_mutant"], "full")
    paired = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    return both.groupBy("project_id").agg(
        F.count("*").alias("mutants"), F.count_if(paired).alias("mutant_pairs"), F.count_if(~paired).alias("unpaired_mutants"),
        F.count_if(paired & (F.col("_a") != "NO_COVERAGE")).alias("covered_mutants"), F.count_if(paired & (F.col("_b") != "KILLED") & (F.col("_a") == "KILLED")).alias("generalized_only_kills"),
    )


def gain_totals(rows: DataFrame) -> DataFrame:
    """One row over the projects of paired_gain(); a duplicate project or an unpaired mutant is an error."""
    checked = rows.agg(F.count("*").alias("projects"), F.countDistinct("project_id").alias("_ids"), F.sum("unpaired_mutants").alias("_unpaired"), F.sum("covered_mutants").alias("covered"), F.sum("generalized_only_kills").alias("kills"), F.count_if(F.col("generalized_only_kills") > 0).alias("gaining_projects"))
    bad = F.when(F.col("projects") != F.col("_ids"), F.raise_error(F.lit("duplicate project")).cast("long")).when(F.col("_unpaired") > 0, F.raise_error(F.lit("unpaired mutants")).cast("long"))
    return checked.select(F.coalesce(bad, F.col("projects")).alias("projects"), "covered", "kills", "gaining_projects", F.round(F.try_divide(F.col("kills") * 100.0, F.col("covered")), 2).alias("gain_pp"))


def view_checks(mutations: DataFrame, extension: DataFrame, mutants: DataFrame, places: DataFrame, covered: DataFrame, extensions: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(position, name, violations, holds) of the fifteen checks of the chain of marts.

    ``extensions`` has, for tests, assertions and generalizations, the entities and their extension's rows, by the same key columns. extension:
    report_extension's columns and ``all``, the number of coverage reports' entities that meet the report; places: locations(). What reports share is asked once:
    mutants have id, the location columns' and blocks, and n, how many reports share them; covered has the locations with coverage and n, how many coverage reports lie there. The counts
    are one row, so that each frame is read once.
    """
    reports = mutations.select("id", "status").join(extension, "id").withColumn("_pair", F.when(F.col("all") > 0, True))
    bare, paired = F.col("status") == "NO_COVERAGE", F.col("_pair").isNotNull()
    tests, assertions, generalizations = (F.col(f"covering_{n}") > 0 for n in ("tests", "assertions", "generalizations"))
    of_reports = [
        ("no uncovered mutant has coverage", bare & paired), ("every other mutant has coverage", ~bare & ~paired), ("no uncovered mutant has covering tests", bare & tests), ("no uncovered mutant has covering assertions", bare & assertions),
        ("covering assertions have covering tests", assertions & ~tests), ("no uncovered mutant has covering generalizations", bare & generalizations), ("every other mutant has covering tests or generalizations", ~bare & ~tests & ~generalizations),
    ]
    known = places.select(*[F.col(c).alias(f"_{c}") for c in LOCATION], "location_id")
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), LOCATION, F.lit(True))  # places with null parts have locations, too
    mapped = lambda rows, keep: rows.select(*keep, *LOCATION).join(known, same, "left").select(*keep, "location_id")
    lost = mapped(covered, ["n"]).agg(F.sum(F.when(F.col("location_id").isNull(), F.col("n"))).alias("_lost"))
    found = mapped(blocks_of(mutants), ["id"]).groupBy("id").agg(F.count("location_id").alias("_l"), F.count_if(F.col("location_id").isNull()).alias("_none"))
    sized = mutants.select("id", "n", F.greatest(F.size(F.from_json("blocks", "array<int>")), F.lit(0)).alias("_n")).join(found, "id", "left").fillna(0, ["_l", "_none"])
    of_mutants = sized.agg(F.sum(F.col("n") * F.col("_none")).alias("_unmapped"), F.sum(F.when(F.col("_n") != F.col("_l") + F.col("_none"), F.col("n"))).alias("_sizes"), F.sum(F.when(F.col("_none") > 0, F.col("n"))).alias("_nulls"))
    own = [rows.dropna().join(ext.distinct(), rows.columns, "left_anti").agg(F.count("*").alias(f"_e{i}")) for i, (_, rows, ext) in enumerate(extensions)]
    row = reduce(DataFrame.crossJoin, [*own, lost, of_mutants, reports.agg(*[F.count_if(c).alias(f"_c{i}") for i, (_, c) in enumerate(of_reports)])])
    checks = [(f"every {name} has its extension", f"_e{i}") for i, (name, _, _) in enumerate(extensions)]
    checks += [("every coverage report is mapped to a location", "_lost"), ("every mutation report is mapped to a location", "_unmapped"), ("every coverage report has a location", "_lost"), ("as many locations as blocks", "_sizes"), ("no location is null", "_nulls")]
    checks += [(name, f"_c{i}") for i, (name, _) in enumerate(of_reports)]
    bands = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.coalesce(c, F.lit(0)).cast("long").alias("violations")) for i, (name, c) in enumerate(checks, 1)])
    whole = row.select(F.inline(bands))
    return whole.withColumn("holds", F.col("violations") == 0)
