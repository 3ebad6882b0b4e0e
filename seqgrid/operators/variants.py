"""Variants (seq_name, position, from_aa, to_aa): text in and out, places, scores."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import CANONICAL, decode, encode
from seqgrid.functions.residues import with_unknown
from seqgrid.sources.lines import counted, split_lines


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, seq_name, position, from_aa, to_aa, label, error): good lines survive bad ones.

    A line is split at tabs if it has one, else at commas. Blank lines and # comments are left out,
    and a first line of known column names. Three fields are name, position and target.
    """
    known = ["seq", "seqname", "sequence", "name", "pos", "position", "from", "ref", "wt", "to", "alt", "mut", "label", "note"]
    raw = counted(split_lines(spark, path), F.lit(True), "line")
    f = F.transform(F.split("value", F.when(F.col("value").contains("\t"), "\t").otherwise(",")), lambda x: F.trim(x))
    rows = raw.where("trim(value) != '' and ltrim(value) not like '#%'").select("file", F.col("line").cast("int").alias("line"), f.alias("f"), F.size(f).alias("k"))
    head = (F.col("line") == 1) & (F.col("k") >= 2) & F.forall("f", lambda x: F.lower(x).isin(known))
    four = F.col("k") >= 4
    got = rows.where(~head).select(
        "file", "line", "k", F.col("f")[0].alias("seq_name"), F.get("f", F.lit(1)).alias("pos"), F.when(four & (F.col("f")[2] != ""), F.upper(F.col("f")[2])).alias("from_aa"),
        F.upper(F.when(four, F.get("f", F.lit(3))).otherwise(F.get("f", F.lit(2)))).alias("to_aa"), F.when(F.col("k") > 4, F.array_join(F.slice("f", 5, 1 << 20), " ")).alias("label"),
    )
    residue = "^[A-Z*-]$"
    error = (
        F.when(F.col("k") < 3, "too few fields")
        .when(F.col("seq_name") == "", "no sequence name")
        .when(~F.col("pos").rlike("^[0-9]{1,9}$") | (F.expr("try_cast(pos as int)") < 1), "bad position")
        .when(~F.coalesce(F.col("to_aa").rlike(residue), F.lit(False)) | ~F.coalesce(F.col("from_aa").rlike(residue), F.lit(True)), "bad residue")
    )
    return got.select("file", "line", "seq_name", F.expr("try_cast(pos as int)").alias("position"), "from_aa", "to_aa", "label", error.alias("error"))


def variant_lines(variants: DataFrame) -> DataFrame:
    return variants.select(F.concat_ws(",", "seq_name", F.col("position").cast("string"), F.coalesce("from_aa", F.lit("")), "to_aa", F.coalesce("label", F.lit(""))).alias("value"))


def first_of_each(variants: DataFrame, order: str) -> DataFrame:
    """One variant for each (seq_name, position, to_aa): the first by the order column."""
    key = ["seq_name", "position", "to_aa"]
    others = [c for c in variants.columns if c not in key]
    return variants.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("v")).select(*key, *[F.col("v")[c].alias(c) for c in others])


def new_variants(variants: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """The first of each (seq_name, position, to_aa) that `known` lacks."""
    return first_of_each(variants, order).join(known.select("seq_name", "position", "to_aa"), ["seq_name", "position", "to_aa"], "left_anti")


def column_of(aligned: Column, position: Column) -> Column:
    """Column, from 0, of the residue at a position from 1; null if the row has no such residue.

    The row is cut at its gaps and their runs are walked once, however far the position is.
    """
    runs = F.split(F.regexp_replace(aligned, "(?<=-)(?=[^-])|(?<=[^-])(?=-)", " "), " ")
    step = lambda s, r: F.when(s["col"].isNotNull(), s).when(r.startswith("-"), F.struct((s["at"] + F.length(r)).alias("at"), s["left"].alias("left"), s["col"].alias("col"))).otherwise(
        F.struct((s["at"] + F.length(r)).alias("at"), (s["left"] - F.length(r)).alias("left"), F.when(s["left"] <= F.length(r), s["at"] + s["left"] - 1).alias("col"))
    )
    zero = F.struct(F.lit(0).alias("at"), position.cast("int").alias("left"), F.lit(None).cast("int").alias("col"))
    return F.when(position >= 1, F.aggregate(runs, zero, step)["col"])


def placed(variants: DataFrame, seqs: DataFrame) -> DataFrame:
    """Variants with aln_id, row_ix (-1 if the sequence is unknown), col and wild (null if out of range).

    Of sequences of one name the last row counts. The place comes from the packed row's runs of gaps.
    """
    last = seqs.groupBy("name").agg(F.max_by(F.struct("aln_id", "row_ix", "aligned"), F.col("row_ix")).alias("s"))
    found = variants.join(last, F.col("seq_name") == F.col("name"), "left").drop("name")
    found = found.withColumn("_at", column_of(F.col("s.aligned"), F.col("position")))
    return found.select(
        *variants.columns, F.col("s.aln_id").alias("aln_id"), F.coalesce("s.row_ix", F.lit(-1)).alias("row_ix"),
        F.col("_at").alias("col"), F.when(F.col("_at").isNotNull(), F.substring("s.aligned", F.col("_at") + 1, F.lit(1))).alias("wild"),
    )


def of_known_sequences(variants: DataFrame, seqs: DataFrame) -> DataFrame:
    """The variants whose sequence exists: those that are scored."""
    return variants.join(seqs.select(F.col("name").alias("seq_name")).distinct(), "seq_name", "left_semi")


def saturation(residues: DataFrame, seqs: DataFrame) -> DataFrame:
    """Every canonical substitution at every residue (aln_id, row_ix, col, residue_ix), as placed variants."""
    to = F.explode(F.array(*[F.lit(a) for a in CANONICAL])).alias("to_aa")
    names = seqs.select("aln_id", "row_ix", "name")
    df = residues.join(names, ["aln_id", "row_ix"]).select(F.col("name").alias("seq_name"), (F.col("residue_ix") + 1).cast("int").alias("position"), F.lit(None).cast("string").alias("from_aa"), "aln_id", "row_ix", "col", to)
    return df.select("seq_name", "position", "from_aa", "to_aa", "aln_id", "row_ix", "col")


def impact_band(score: Column) -> Column:
    return F.when(score < 34, "low").when(score < 67, "medium").when(score.isNotNull(), "high")


def variants_at(sited: DataFrame, order: str) -> DataFrame:
    """(aln_id, row_ix, col, from_aa, to_aa, score, band): the first variant at each cell by the order column, of placed variants with a score.

    from_aa is the one stated, else the residue there. Without a score, score and band are null.
    """
    told = F.struct(F.coalesce("from_aa", "wild", F.lit("\u00b7")).alias("from_aa"), "to_aa", "score")
    first = sited.where("col is not null").groupBy("aln_id", "row_ix", "col").agg(F.min_by(told, F.col(order)).alias("v")).select("aln_id", "row_ix", "col", "v.*")
    return first.withColumn("band", impact_band(F.col("score")))


def markers(sited: DataFrame) -> DataFrame:
    """(aln_id, row_ix, col, seq_name, position, to_aa, score, band): a pin for each placed variant; no score counts as 0."""
    score = F.coalesce("score", F.lit(0)).alias("score")
    return sited.where("col is not null").select("aln_id", "row_ix", "col", "seq_name", "position", "to_aa", score).withColumn("band", impact_band(F.col("score")))


def score_variants(sited: DataFrame, stats: DataFrame, track: DataFrame, scores: DataFrame) -> DataFrame:
    """(..., ref, score 0..100, kind, confidence, note, band) of placed variants.

    The reference residue is from_aa, else the column's consensus; conservation is the track's score,
    else the consensus share. Variants without a column score 0. Residues that the scores lack count as X,
    and as -1 if they have no X either.
    """
    facts = stats.join(track.withColumnRenamed("score", "cons"), ["aln_id", "col"], "left")
    facts = facts.select("aln_id", "col", "consensus", F.coalesce("cons", F.col("consensus_frac") * 100).alias("cons"))
    df = sited.join(facts, ["aln_id", "col"], "left")
    df = df.withColumn("a", F.coalesce(encode(F.col("from_aa")), "consensus")).withColumn("b", encode(F.col("to_aa")))
    df = df.join(F.broadcast(with_unknown(scores)), ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(-1.0)))
    gap, same = F.col("b") == 0, F.col("a") == F.col("b")
    pen = F.when(gap, 0.9).when(same, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (4 - F.col("s")) / 8)))
    #: 0.9 for a deletion, 0.35 and 0.65 as shares without and with conservation.
    score = F.when(F.col("cons").isNull(), 0).otherwise(F.floor(100 * pen * (0.35 + 0.65 * F.col("cons") / 100) + 0.5)).cast("long")
    kind = F.when(F.col("cons").isNull(), "unplaced").when(gap, "deletion").when(same, "same").when(F.col("s") >= 1, "conservative").when(F.col("s") <= -2, "radical").otherwise("moderate")
    change = F.concat(decode(F.col("a")), F.lit("\u2192"), F.when(gap, "gap deletion").otherwise(F.concat(decode(F.col("b")), F.lit(" "), kind, F.format_string(" (score %+d)", F.col("s").cast("int")))))
    said = F.concat(F.lit("conserved "), F.floor(F.col("cons") + 0.5).cast("string"), F.lit(" \u00b7 "), F.when(same & ~gap, "synonymous (no residue change)").otherwise(change))
    note = F.when(F.col("cons").isNull(), "position not mapped to a column").otherwise(said)
    out = df.select(*sited.columns, decode(F.col("a")).alias("ref"), score.alias("score"), kind.alias("kind"), F.coalesce(F.col("cons") / 100, F.lit(0.0)).alias("confidence"), note.alias("note"))
    return out.withColumn("band", impact_band(F.col("score")))
