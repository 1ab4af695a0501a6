"""Structure of code: declared names, edges from facts, evidence scores, seeds, packet status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that open a declaration, and words that may stand before one of them.
KEYWORDS = "class def defmodule defn enum fn func function impl interface module namespace object package record struct sub trait type".split()
MODIFIERS = "abstract async case data export final internal open private protected public sealed static pub".split()

# Syntax kinds by kind of declaration; all others are `other`.
FUNCTIONS = """function_declaration function_definition function_item method_definition method_declaration constructor_declaration
abstract_method_signature method singleton_method protocol_function_declaration function""".split()
TYPES = """class_declaration class_definition class_specifier class interface_declaration annotation_type_declaration
enum_declaration enum_definition enum_item enum_specifier record_declaration struct_declaration struct_item struct_specifier
union_item union_specifier trait_definition trait_item trait_declaration object_definition object_declaration
protocol_declaration type_spec type_alias type_alias_declaration typealias_declaration type_definition alias_declaration
delegate_declaration""".split()
VARIABLES = "assignment lexical_declaration variable_declaration pair block_mapping_pair flow_pair bind".split()

#: A declaration counts as so many mentions.
DECLARED_WEIGHT = 3
MOST_DECLARERS = 8
SEEDS, SEEDS_OF_A_FILE = 8, 3

SPACE = r"\p{IsWhite_Space}"
DECLARATION = rf"^{SPACE}*(?:(?:{'|'.join(MODIFIERS)}){SPACE}+){{0,14}}(?:{'|'.join(KEYWORDS)}){SPACE}+([A-Za-z_][A-Za-z0-9_]*)"


def declared_name(line: Column) -> Column:
    """The name that a line declares, or null."""
    return F.nullif(F.regexp_extract(line, DECLARATION, 1), F.lit(""))


def declaration_kind(syntax: Column) -> Column:
    return F.when(syntax.isin(FUNCTIONS), "function").when(syntax.isin(TYPES), "type").when(syntax.isin(VARIABLES), "variable").otherwise("other")


def resolve(uses: DataFrame, declared: DataFrame, local: str) -> DataFrame:
    """uses with target and resolution: in the file itself, else the only declaration of the whole scope.

    uses: file, name and others. declared: file, name, node. local: which declaration of the file is meant; `first`,
    the one with the smallest node, or `only`, one that has no namesake in the file. Both joined sides have one row a
    key, so no use becomes two.
    """
    in_file = declared.groupBy("file", "name").agg(F.min("node").alias("own"), F.count("*").alias("n_own"))
    in_scope = in_file.groupBy("name").agg(F.min("own").alias("any"), F.sum("n_own").alias("n_any"))
    found = uses.join(in_file, ["file", "name"], "left").join(in_scope, "name", "left")
    is_local = F.col("n_own").isNotNull() if local == "first" else F.coalesce(F.col("n_own") == 1, F.lit(False))
    only = F.coalesce(F.col("n_any") == 1, F.lit(False))
    return found.select(
        *uses.columns,
        F.when(is_local, F.col("own")).when(only, F.col("any")).alias("target"),
        F.when(is_local, "local").when(only, "scope").when(F.col("n_any") > 1, "ambiguous").otherwise("unresolved").alias("resolution"),
    )


def exports(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """uses with the first declaration of that name in the file, or null."""
    return uses.join(declared.groupBy("file", "name").agg(F.min("node").alias("target")), ["file", "name"], "left")


def declarers(declared: DataFrame) -> DataFrame:
    """Names that one to MOST_DECLARERS files declare."""
    return declared.groupBy("name").agg(F.count_distinct("file").alias("files")).filter(F.col("files") <= MOST_DECLARERS)


def evidence_scores(mentioned: DataFrame, declared: DataFrame, wanted: DataFrame, n_files: int) -> DataFrame:
    """(file, score, matched): integer rarity of each wanted name, DECLARED_WEIGHT times for declarations.

    mentioned and declared: distinct (file, name). A name's frequency is the larger of its two.
    """
    both = mentioned.withColumn("declares", F.lit(0)).unionByName(declared.withColumn("declares", F.lit(1))).join(wanted, "name", "left_semi")
    df = both.groupBy("name").agg(F.greatest(F.sum("declares"), F.sum(1 - F.col("declares"))).alias("df"))
    weight = F.length(F.bin(F.greatest(F.expr(f"{n_files} div df"), F.lit(1).cast("long"))))
    scored = both.join(df.select("name", weight.alias("w")), "name")
    return scored.groupBy("file").agg(F.sum(F.col("w") * F.when(F.col("declares") == 1, DECLARED_WEIGHT).otherwise(1)).cast("long").alias("score"), F.count_distinct("name").alias("matched"))


def admit_seeds(candidates: DataFrame, task: str, path: str, order: list[str], node: str) -> DataFrame:
    """The first SEEDS candidates of each task, at most SEEDS_OF_A_FILE of one file, with their place.

    A candidate right after one of the same node is dropped; one further on is not, so a node can take two places.
    """
    line = Window.partitionBy(task).orderBy(*order)
    single = candidates.withColumn("_last", F.lag(node).over(line)).filter(~F.col(node).eqNullSafe(F.col("_last")) | F.col("_last").isNull()).drop("_last")
    of_file = single.withColumn("_n", F.row_number().over(Window.partitionBy(task, path).orderBy(*order))).filter(F.col("_n") <= SEEDS_OF_A_FILE)
    return of_file.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= SEEDS).drop("_n")


def first_of_each(rows: DataFrame, visible: list[str], order: list[str]) -> DataFrame:
    """The first row of those that look alike; a minimum that combines map-side, so repeats are not shuffled."""
    rest = [c for c in rows.columns if c not in visible and c not in order]
    first = rows.groupBy(*visible).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*visible, "_f.*")


def supporting_last(items: DataFrame, task: str, supporting: Column, order: str) -> DataFrame:
    """items with their place: the supporting ones after the others, else as they were."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(task).orderBy(supporting, order)))


def packet_status(compatible: Column, intact: Column, authorized: Column, complete: Column, fresh: Column) -> Column:
    """The first check that fails names the status."""
    return F.when(~compatible, "incompatible").when(~intact, "corrupt").when(~authorized, "denied").when(~complete, "partial").when(~fresh, "stale").otherwise("current")


def workspace_decision(required: Column, workspace: Column) -> Column:
    return F.when(required & workspace.isNull(), "deny").otherwise("allow")
