"""Sources: file trees, review JSON, ignore rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import any_of, glob_regex, path_parts

LARGEST_FILE, LARGEST_TEXT = 10 * 2**20, 2**20
MOST_FILES, DEEPEST = 100_000, 50
SNIFF = 8192


def excluded(path: Column, rules: tuple[str, ...]) -> Column:
    """Exclude rules of four kinds: ``name/`` is a run of path components, ``a*b`` matches from the left, a bare name is a file's name, else a part of the path."""
    tests = []
    for rule in rules:
        if rule.endswith("/"):
            tests.append(F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/" + rule.strip("/") + "/")))
        elif "*" in rule:
            tests.append(F.rlike(path, F.lit("^(?:" + glob_regex(rule)[1:-1] + ")")))
        elif "/" not in rule:
            tests.append(F.element_at(F.split(path, "/"), -1) == rule)
        else:
            tests.append(F.contains(path, F.lit(rule)))
    return any_of(tests)


def looks_binary(content: Column) -> Column:
    """Whether the first 8192 bytes hold a NUL, or more than 30 % bytes that aren't text."""
    head = F.hex(F.substring(content, 1, SNIFF))
    odd = F.regexp_count(head, F.lit(r"\G(?:[0-9A-F]{2})*?(?:0[0-6BE-F]|1[0-9AC-F]|7F)"))
    return F.regexp_like(head, F.lit("^(?:[0-9A-F]{2})*00")) | (odd > 0.3 * F.length(head) / 2)


def read_tree(spark: SparkSession, root: str, rules: tuple[str, ...] = (), largest: int = LARGEST_FILE) -> DataFrame:
    """(path, content, length, modification_time) of the text files under root; size and pattern filters reach the scan.

    Paths outside root can't come up, since Spark lists root itself; paths
    deeper than DEEPEST are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= largest)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + "".join("\\" + c if not c.isalnum() else c for c in base.replace("file:///", "file:/")) + "/", "")
    rows = raw.select(path.alias("path"), "content", "length", F.col("modificationTime").alias("modification_time"))
    rows = rows.where(~excluded(F.col("path"), rules) & (F.size(path_parts(F.col("path"))) <= DEEPEST))
    return rows.where(~looks_binary(F.col("content"))).withColumn("content", F.decode("content", "UTF-8"))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Rows of review JSON: a list, or an object with a list under findings, items, review or issues."""
    row = "struct<file:string,file_path:string,line:string,line_number:string,title:string,summary:string,message:string,description:string,severity:string,category:string,type:string,confidence:string,detected_by:string>"
    text = spark.read.text(path, wholetext=True)
    lists = [F.from_json("value", f"array<{row}>")]
    lists += [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{row}>") for k in ("findings", "items", "review", "issues")]
    bare = F.when(F.rlike("value", F.lit(r"^\s*\[")), lists[0])
    return text.select(F.explode(F.coalesce(bare, *lists[1:])).alias("r")).select("r.*")


def parse_ignore(rules: DataFrame, column: str = "line") -> DataFrame:
    """(kind, rule) of ignore lines: ``:name`` is a type, what else is not empty or a comment is a glob."""
    line = F.trim(F.col(column))
    rows = rules.select(line.alias("line")).where((F.length("line") > 0) & ~F.startswith("line", F.lit("#")))
    is_type = F.startswith("line", F.lit(":"))
    rows = rows.select(F.when(is_type, F.lit("type")).otherwise("glob").alias("kind"), F.when(is_type, F.trim(F.expr("substring(line, 2)"))).otherwise(F.col("line")).alias("rule"))
    return rows.where(F.length("rule") > 0)
