"""Trees as text: Newick and NEXUS to node tables and back, many trees at once.

Node tables: (tree_id, node_id, parent_id, child_ix, name, length, support). A node starts behind an
opening bracket or a comma, at the place that becomes its node_id; its parent is the bracket around it,
the last one opened at its depth. So nodes come from running sums and maxima over the tokens of a tree.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.operators.trees import spans

_TOKEN = r"'(?:[^']|'')*'|[(),;]|:[-0-9.eE+]*|[^:,();']+"


def _plain(text):
    """The Newick text of a tree file, and its translation pairs if it is NEXUS."""
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")
    nexus = text.rlike("(?i)#nexus")
    first = F.regexp_extract(bare, r"(?is)\btree\s+[^=]+=\s*([^;]+);", 1)
    pairs = F.split(F.regexp_extract(bare, r"(?is)translate(.*?);", 1), ",")
    pair = lambda p: F.struct(F.regexp_extract(p, r"^\s*(\S+)\s", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, r"(?s)^\s*\S+\s+(.+)$", 1)), "^'|'$", "").alias("v"))
    return F.when(nexus, first).otherwise(text), F.transform(F.when(nexus, pairs).otherwise(F.array().cast("array<string>")), pair).cast("array<struct<k:string,v:string>>")


def parse_trees(trees: DataFrame, replicates: int = 0) -> DataFrame:
    """Nodes of trees (tree_id, text). Numbers behind a bracket are support out of `replicates`, or percent.

    Of a NEXUS text the first tree counts, its leaves named by the translation. A text without a tree has
    no nodes.
    """
    newick, pairs = _plain(F.col("text"))
    # Tokens are cut out once a text, before they become rows: no row carries the text. A start token counts as a bracket around the root.
    tokens = F.regexp_extract_all(newick, F.lit(_TOKEN), F.lit(0))
    cut_out = trees.select("tree_id", pairs.alias("pairs"), tokens.alias("tokens")).where(F.exists("tokens", lambda t: F.trim(t) != ""))
    raw = cut_out.select("tree_id", "pairs", F.posexplode(F.concat(F.array(F.lit("")), "tokens")).alias("at", "t")).where("at = 0 or trim(t) != ''").withColumn("at", F.col("at") - 1)
    order = W.partitionBy("tree_id").orderBy("at")
    opens, closes = F.col("t") == "(", F.col("t") == ")"
    deep = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    tok = raw.select("*", (F.row_number().over(order) - 2).alias("pos"), F.lead("t").over(order).alias("next"), F.lead("t", 2).over(order).alias("next2"), deep.alias("deep"))
    tok = tok.where("t in ('', '(', ',', ')')").withColumn("level", F.col("deep") + closes.cast("int"))
    inside = W.partitionBy("tree_id", "level").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    tok = tok.withColumn("around", F.max(F.when(opens, F.col("pos"))).over(inside))
    # What follows a bracket's end, or a leaf's start: a label and a length, either may lack.
    labelled = ~F.coalesce(F.col("next"), F.lit(";")).rlike("^[(),;:]")
    label = F.when(labelled, F.trim(F.when(F.col("next").startswith("'"), F.replace(F.expr("substring(next, 2, length(next) - 2)"), F.lit("''"), F.lit("'"))).otherwise(F.col("next"))))
    size = F.when(labelled, F.col("next2")).otherwise(F.col("next"))
    length = F.when(size.startswith(":"), F.expr("try_cast(substring(if(next rlike '^[(),;:]', next, next2), 2) as double)"))
    tok = tok.withColumn("label", label).withColumn("length", F.coalesce(length, F.lit(0.0)))
    starts = tok.where("t != ')'").withColumn("leaf", ~F.coalesce(F.col("next") == "(", F.lit(False)))
    ends = tok.where("t = ')'").select("tree_id", (F.col("around") - 1).alias("pos"), F.col("label").alias("e_label"), F.col("length").alias("e_length"))
    nodes = starts.join(ends, ["tree_id", "pos"], "left")
    nth = W.partitionBy("tree_id", "around").orderBy("pos")
    translated = F.expr("element_at(filter(pairs, p -> p.k = label), -1).v")
    name = F.when(F.col("leaf"), F.coalesce(F.when(F.expr("exists(pairs, p -> p.k = label)"), translated), "label", F.lit("")))
    support = F.expr("try_cast(e_label as double)") / F.lit(float(replicates or 100))
    return nodes.select(
        "tree_id", F.col("pos").cast("int").alias("node_id"), (F.col("around") - 1).cast("int").alias("parent_id"),
        (F.row_number().over(nth) - 1).alias("child_ix"), name.alias("name"),
        F.when(F.col("leaf"), F.col("length")).otherwise(F.coalesce("e_length", F.lit(0.0))).alias("length"),
        F.when(~F.col("leaf"), support).alias("support"),
    )


def _number(x):
    """Six decimals at most, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.6f", F.round(x, 6)), r"\.?0+$", "")


def format_newick(nodes: DataFrame, replicates: int = 0) -> DataFrame:
    """(tree_id, text) of node tables. A node opens at its place in the tree's order; an inner one closes behind
    the last node below it, inner brackets first."""
    df = spans(nodes)
    df = df.withColumn("nth", F.row_number().over(W.partitionBy("tree_id", "parent_id").orderBy("child_ix")))
    quoted = F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'"))
    name = F.coalesce(F.when(F.col("name").rlike(r"[\s(),:;']"), quoted).otherwise(F.col("name")), F.lit(""))
    tail = F.when(F.col("parent_id").isNull(), F.lit(";")).otherwise(F.concat(F.lit(":"), _number(F.col("length"))))
    comma = F.when((F.col("nth") > 1) & F.col("parent_id").isNotNull(), ",").otherwise("")
    support = F.when(F.col("support").isNotNull() & F.col("parent_id").isNotNull(), F.floor(F.col("support") * (replicates or 100) + 0.5).cast("string")).otherwise("")
    token = lambda at, closes, inmost, text: F.struct(at.alias("at"), F.lit(closes).alias("closes"), inmost.alias("inmost"), text.alias("text"))
    opening = token(F.col("enter"), 0, F.col("enter"), F.concat(comma, F.when(F.col("leaf"), F.concat(name, tail)).otherwise("(")))
    closing = token(F.col("enter") + F.col("size") - 1, 1, -F.col("enter"), F.concat(F.lit(")"), support, tail))
    each = df.select("tree_id", F.explode(F.when(F.col("leaf"), F.array(opening)).otherwise(F.array(opening, closing))).alias("x"))
    parts = F.sort_array(F.collect_list("x"))
    return each.groupBy("tree_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
