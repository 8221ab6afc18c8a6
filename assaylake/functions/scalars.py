"""Column functions of the domain; every one is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offsets of the variant families in their order.
VARIANT_BASE = {"ORIGINAL": 10_000_000, "INITIAL": 20_000_000, "BASELINE": 30_000_000, "NAIVE": 40_000_000, "IMPROVED": 60_000_000}
#: Type names by domain.
TYPE_DOMAINS = {
    "INTEGER": ("byte", "short", "int", "long", "Byte", "Short", "Integer", "Long"),
    "REAL": ("float", "double", "Float", "Double"),
    "BOOLEAN": ("boolean", "Boolean"),
    "CHAR": ("char", "Character"),
    "STRING": ("String",),
}


def simple_name(c: Column) -> Column:
    """The text after the last dot; null stays null."""
    return F.substring_index(c, ".", -1)


def last_segment(path: Column) -> Column:
    """The last path segment. A path with a slash but nothing after the last one is an error."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when((name == "") & path.contains("/"), F.raise_error(F.concat(F.lit("no last segment: "), path))).otherwise(name)


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, or null where the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def variant_name(stage: Column, variant: Column) -> Column:
    """The variant, else ORIGINAL or INITIAL by the end of the stage's name, else null."""
    return F.coalesce(variant, F.when(stage.endswith("_ORIGINAL"), "ORIGINAL").when(stage.endswith("_INITIAL"), "INITIAL"))


def variant_order(variant: Column) -> Column:
    """Null is 0; a family's base plus its number of tries; anything else but _<number>_TRIES behind the family's name, and an unknown one, is an error."""
    family, tries = F.regexp_replace(variant, r"_\d+_TRIES$", ""), F.coalesce(matched(variant, r"_(\d+)_TRIES$").cast("int"), F.lit(0))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in VARIANT_BASE.items() for x in kv]), family)
    return F.when(variant.isNull(), 0).when(F.try_element_at(F.create_map(*[F.lit(x) for kv in VARIANT_BASE.items() for x in kv]), family).isNull(), F.raise_error(F.concat(F.lit("unknown variant "), variant)).cast("int")).otherwise(base + tries)


def excluded_by(info: Column) -> Column:
    """What stands between 'Excluded by ' and '{'; null where either is missing."""
    return matched(info, r"Excluded by ([^{]*)\{")


def percent(part: Column, whole: Column, on_zero: float | None = None) -> Column:
    """100 * part / whole to two places; null, or ``on_zero``, where whole is 0."""
    share = F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), 2)
    return share if on_zero is None else F.coalesce(share, F.lit(on_zero))


def older(a: Column, b: Column) -> Column:
    """Dotted versions compared number by number."""
    numbers = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    return numbers(a) < numbers(b)


def not_in_or_null(c: Column, values: list) -> Column:
    """True for null and for anything outside the list."""
    return c.isNull() | ~c.isin(values) if values else F.lit(True)


def non_nulls(*columns: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def first_present(*columns: Column) -> Column:
    """An array of the values that are not null, in order."""
    return F.array_compact(F.array(*columns))


def identity_key(*columns: Column) -> Column:
    """One text of several columns, nulls written as <null>."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<null>")) for c in columns])


def type_domain(name: Column) -> Column:
    """INTEGER, REAL, BOOLEAN, CHAR, STRING, ARRAY for names that end in [], else OBJECT; null stays null."""
    simple, out = simple_name(name), F.when(name.endswith("[]"), "ARRAY")
    for domain, names in TYPE_DOMAINS.items():
        out = out.when(simple.isin(*names), domain)
    return out.when(name.isNotNull(), "OBJECT")


def config_hash(config: Column, scoped: tuple[str, ...]) -> Column:
    """SHA-256 of a JSON object of strings without its run-scoped keys, keys in order."""
    entries = F.array_sort(F.map_entries(F.map_filter(F.from_json(config, "map<string,string>"), lambda k, _: ~k.isin(*scoped))))
    return F.sha2(F.to_json(entries), 256)


def ordered_rules(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, label in rules:
        out = out.when(condition, label)
    return out.otherwise(otherwise) if otherwise is not None else out


#: The stages of a run in their order, from 0.
STAGES = (
    "CLEANUP_PROJECT", "DOWNLOAD_PROJECT", "SETUP_PROJECT", "ADD_DEPENDENCIES", "BUILD_PROJECT_ORIGINAL", "GENERATE_EVOSUITE_TESTS", "POSTPROCESS_EVOSUITE_TESTS", "BUILD_SPOON_MODEL",
    "EXECUTE_TESTS_ORIGINAL", "COLLECT_JUNIT_REPORTS_ORIGINAL", "FILTER_TESTS_ORIGINAL", "ANALYZE_TESTS", "FILTER_TESTS", "FILTER_ASSERTIONS", "ADD_JPF_INSTRUMENTATION", "BUILD_PROJECT_INSTRUMENTED",
    "EXECUTE_JPF", "ANALYZE_JPF", "CLEANUP_JPF_INSTRUMENTATION", "BUILD_PROJECT_INITIAL", "EXECUTE_TESTS_INITIAL", "COLLECT_JUNIT_REPORTS_INITIAL", "CLEANUP_GENERALIZATION", "GENERALIZE_TESTS",
    "BUILD_PROJECT_GENERALIZED", "EXECUTE_TESTS_GENERALIZED", "COLLECT_JUNIT_REPORTS_GENERALIZED", "FILTER_GENERALIZATIONS", "RESTORE_ORIGINAL_BUILD", "COLLECT_JACOCO_DATA_ORIGINAL",
    "COLLECT_PIT_DATA_ORIGINAL", "COLLECT_JACOCO_DATA_INITIAL", "COLLECT_PIT_DATA_INITIAL", "RESTORE_GENERALIZED_BUILD", "COLLECT_JACOCO_DATA_GENERALIZED", "COLLECT_PIT_DATA_GENERALIZED",
)
#: Fixed value: variants that reports compare.
VARIANT_PATTERN = r"^(BASELINE|NAIVE_\d+_TRIES|IMPROVED_\d+_TRIES)$"


def _ordered(c: Column, names: tuple | list, null: int) -> Column:
    place = F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), c)
    return F.when(c.isNull(), null).otherwise(F.coalesce(place, F.raise_error(F.concat(F.lit("no order for "), c)).cast("int")))


def stage_order(stage: Column) -> Column:
    """A stage's place from 0; null is -1, an unknown stage is an error."""
    return _ordered(stage, STAGES, -1)


def level_order(level: Column) -> Column:
    """Tests, assertions, generalizations; null is -1, an unknown level is an error."""
    return _ordered(level, ("test", "assertion", "generalization"), -1)


def compared_variant(variant: Column) -> Column:
    return F.coalesce(variant.rlike(VARIANT_PATTERN), F.lit(False))


def part_of(c: Column, separator: str, n: int) -> Column:
    """The n-th part between separators, from the end where n is negative; '' beyond the parts."""
    return F.split_part(c, F.lit(separator), F.lit(n))


def declaring_type(path: Column) -> Column:
    """The type name of a model path such as #subPackage[name=a]#containedType[name=B]#method…; null without a method part."""
    head = matched(path, r"^(.*)#method")
    dotted = F.regexp_replace(F.regexp_replace(head, r"#subPackage\[name=([^\]]+)\]", "$1."), r"#containedType\[name=([^\]]+)\]", "$1.")
    return F.rtrim(dotted, F.lit("."))


def json_kind(c: Column) -> Column:
    """array, object, string, number, boolean or null of a JSON text; SQL null where it is no JSON."""
    parsed = F.try_parse_json(c)
    schema = F.schema_of_variant(parsed)
    return (
        F.when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def short_filter(name: Column, aliases: dict[str, str]) -> Column:
    """A filter's simple name, or its alias."""
    simple = simple_name(name)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), simple), simple) if aliases else simple


def short_combo(combo: Column, aliases: dict[str, str], separator: str = "+") -> Column:
    """The same for every name of a combination."""
    return F.array_join(F.transform(F.split(combo, f"\\{separator}"), lambda n: short_filter(n, aliases)), separator)


def display_project(name: Column, names: dict[str, str]) -> Column:
    """The display name of a project: its last path segment if it is a path, then the mapping, else itself."""
    plain = F.trim(name)
    last = F.when(plain.startswith("/"), F.substring_index(plain, "/", -1)).otherwise(plain)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), last), last) if names else last


def prefix_and_budget(name: Column) -> tuple[Column, Column]:
    """(prefix, budget) of <prefix>-es-default-<n>s; both null elsewhere."""
    pattern = r"^(.+)-es-default-(\d+s)$"
    return matched(name, pattern, 1), matched(name, pattern, 2)


def base_name(name: Column) -> Column:
    """What stands before -es-; the whole name where that is absent."""
    return F.substring_index(name, "-es-", 1)


def normalized_text(c: Column) -> Column:
    """Lines without white space at their ends."""
    return F.regexp_replace(c, r"(?m)[^\S\n]+$", "")


def has_specification(size: Column, output: Column, none: str = "NULL_CONCRETE") -> Column:
    """A rendered size above 0 in the statistics' JSON, and an output class other than ``none``."""
    return F.coalesce(F.get_json_object(size, "$.size").cast("int") > 0, F.lit(False)) & output.isNotNull() & (output != none)


def in_list(c: Column, values: list) -> Column:
    """Membership; null is in no list."""
    return F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)


def matches_like(c: Column, pattern: str) -> Column:
    """LIKE with its wildcards: % for any text and _ for any one character."""
    return F.coalesce(c.like(pattern), F.lit(False))


def last_exception(text: Column) -> Column:
    """The last qualified exception or error name in a diagnostic text; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z_$][\w$]*\.)+[A-Z][\w$]*(?:Exception|Error))"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))
