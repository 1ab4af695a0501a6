"""A workspace of source files over the driver's tables: one Python module per customer, one script per supplier, manifests.

The SQL below is read alike by Spark and by the oracle's engine, so both see the same bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.sources.artifacts import table

C, BASE = "cast(c_custkey as string)", "cast(cast(floor(c_custkey / 2) as bigint) as string)"
MODULE_DIR = "cast({} % 40 as string)"
NL = "chr(10)"


def mod(k: int, of: str = "c_custkey") -> str:
    return f"cast({of} % {k} as string)"


def lines(*rows: str) -> str:
    return "concat(" + f", {NL}, ".join(rows) + ")"


#: The text of each declaration of a module, without the newline after it.
LIMIT = f"concat('LIMIT_', {mod(13)}, ' = ', {C})"
LOAD = lines(f"concat('def load_', {mod(7)}, '(self, value):')", f"concat('        total = helper_', {mod(11)}, '(value)')", "'        return total'")
TOTAL = f"concat('total = helper_', {mod(11)}, '(value)')"
SAVE = lines("'def save(self):'", f"concat('        return work_', {C}, '(LIMIT_', {mod(13)}, ')')")
MODEL = f"concat('class Model', {C}, case when c_custkey % 10 = 4 then '' else concat('(Model', {BASE}, ')') end, ':', {NL}, '    ', {LOAD}, {NL}, '    ', {SAVE})"
INNER = lines("'def inner(x):'", "'        return x'")
HELPER = f"concat('def helper_', {mod(11)}, '(value):', {NL}, '    ', {INNER}, {NL}, '    return inner(value)')"
WORK = lines(f"concat('def work_', {C}, '(value):')", f"concat('    helper_', {mod(11, '(c_custkey + 1)')}, '(value)')", f"concat('    missing_', {C}, '(value)')", f"concat('    return shared_', {mod(17)}, '(value)')")
SHARED = lines(f"concat('def shared_', {C}, '(value):')", "'    return value'")
IMPORT = f"case when c_custkey % 10 = 4 then 'import os' when c_custkey % 10 = 3 then concat('from ..missing.m', {BASE}, ' import Model', {BASE}) else concat('from ..c', {MODULE_DIR.format('cast(floor(c_custkey / 2) as bigint)')}, '.m', {BASE}, ' import Model', {BASE}) end"
MODULE = f"concat({IMPORT}, {NL}, {LIMIT}, {NL}, {MODEL}, {NL}, {HELPER}, {NL}, {WORK}, {NL}, case when c_custkey < 17 then concat({SHARED}, {NL}) else '' end)"
MODULE_PATH = f"concat('pkg/c', {MODULE_DIR.format('c_custkey')}, '/m', {C}, '.py')"

S, S_BASE = "cast(s_suppkey as string)", "cast(cast(floor(s_suppkey / 2) as bigint) as string)"
SCRIPT = lines(f"concat('import {{ call', {S_BASE}, ' }} from ', chr(39), './s', {S_BASE}, chr(39), ';')", f"concat('export function call', {S}, '(x) {{ return call', {S_BASE}, '(x); }}')", "''")
SCRIPT_PATH = f"concat('web/s', {S}, '.ts')"
MANIFEST = "concat('{\"name\": \"r', cast(r_regionkey as string), '\", \"deps\": {\"a\": 1}}')"
MANIFEST_PATH = "concat('area', cast(r_regionkey as string), '/package.json')"

#: (path, content) of all files, for either dialect.
FILES_SQL = f"select {MODULE_PATH} as path, {MODULE} as content from customer union all select {SCRIPT_PATH}, {SCRIPT} from supplier union all select {MANIFEST_PATH}, {MANIFEST} from region"


#: Tasks a core that the files are dealt to.
TASKS_A_CORE = 4


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the workspace; content as bytes.

    A key of some bytes stands for a text that takes a millisecond to parse, so a table of a million keys is one split of its
    file. Keys are dealt to all cores before texts are made of them.
    """
    parts = [("customer", "c_custkey", MODULE_PATH, MODULE), ("supplier", "s_suppkey", SCRIPT_PATH, SCRIPT), ("region", None, MANIFEST_PATH, MANIFEST)]
    out = None
    for name, key, path, content in parts:
        part = table(spark, sf_dir, name)
        if key:
            part = part.select(key).repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, key)
        part = part.selectExpr(f"{path} as path", f"cast({content} as binary) as content")
        out = part if out is None else out.unionByName(part)
    return out
