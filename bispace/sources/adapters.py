"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, two vectors of a node, a cluster in each space, two exclusion groups."""
    e = table(spark, sf_dir, "embeddings")
    half = lambda a: F.slice("embedding", a, 32).cast("array<double>")
    return e.select(
        F.col("vec_id").alias("id"), half(1).alias("gex"), half(33).alias("tcr"), F.col("label").cast("long").alias("cg"),
        ((F.col("label") + F.col("vec_id") % 3) % 10).cast("long").alias("ct"), F.expr("vec_id div 2").alias("ag"), (F.col("vec_id") % 250).alias("bg"),
    )


def cell_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("feature"), F.col("l_quantity").alias("value"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.col("o_custkey").alias("clone"), F.col("l_orderkey").alias("barcode"), F.when(F.col("l_linenumber") % 2 == 1, "A").otherwise("B").alias("ab"),
        F.concat_ws("|", "p_brand", "p_type", "p_name").alias("chain"), F.col("l_quantity").cast("long").alias("umis"), (F.col("l_linestatus") == "O").alias("productive"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clone"), F.col("event_type").alias("batch"))


def letters(column: str):
    """The amino-acid letters of a text, from its ASCII letters."""
    return F.regexp_replace(F.upper(F.regexp_replace(column, "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")


def windows(spark: SparkSession, sf_dir: str, name: str, key: str, parts: int | None = None) -> DataFrame:
    """id, pos, v, seq: the whole letters of each text in consecutive windows, from position ``pos``.

    Windows have 12 to 16 letters; what is left at the end is a window of its own from five letters
    on, or else belongs to the last one. Only texts without letters have none. With ``parts`` texts are
    first dealt into so many tasks, however few row groups the files have.
    """
    t = table(spark, sf_dir, name)
    t = t.select(*(c for c in (key, "text", "source") if c in t.columns)).repartition(parts) if parts else t
    v = F.col("source") if "source" in t.columns else F.lit(None).cast("string")
    d = t.select(F.col(key).alias("id"), v.alias("v"), letters("text").alias("s")).where("length(s) > 0")
    d = d.withColumn("w", F.expr("12 + cast(pmod(coalesce(id, 0), 5) as int)")).withColumn("k", F.expr("cast(greatest(1, length(s) div w + if(length(s) % w >= 5, 1, 0)) as int)"))
    # cut in one pass over a text; a substring would walk to its place from the text's start each time
    d = d.withColumn("x", F.expr("regexp_extract_all(s, concat('.{1,', w, '}'), 0)"))
    whole = F.expr("if(size(x) > k, concat(slice(x, 1, k - 1), array(concat(x[k - 1], x[k]))), x)")
    return d.select("id", "v", "w", F.posexplode(whole).alias("p", "seq")).select("id", (F.col("p") * F.col("w") + 1).alias("pos"), "v", "seq")


def runs(spark: SparkSession, sf_dir: str, name: str, key: str, size: int = 5) -> DataFrame:
    """id, pos, seq: the run of ``size`` letters at every position of each whole text; a shorter text is one."""
    d = table(spark, sf_dir, name).select(F.col(key).alias("id"), letters("text").alias("s")).where("length(s) > 0")
    d = d.withColumn("pos", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("s") - size + 1))))
    return d.select("id", "pos", F.substring("s", F.col("pos"), F.lit(size)).alias("seq"))


# ---- receptors from the rows of a table with a key and a nation --------------------------------
def _hex_letters(x: str, alphabet: str = "ACDEFGHIKLMNPQRS") -> str:
    return f"translate({x}, '0123456789abcdef', '{alphabet}')"


def _piece(tag: str, of: str, first: str, size: str, alphabet: str = "ACDEFGHIKLMNPQRS") -> str:
    return _hex_letters(f"substr(md5(concat('{tag}', {of})), {first}, cast({size} as int))", alphabet)


def receptor_columns(k: str, n: str) -> dict[str, str]:
    """SQL expressions (of both engines) of a receptor from a key and a nation: genes from both,
    CDR3s from a stem of the nation and a few letters of the key."""
    a = f"concat('CAV', {_piece('a', f'{n} % 12', '1', f'3 + {n} % 3')}, {_piece('x', f'{k} % 40', '1', f'1 + {k} % 3')}, 'YTF')"
    b = f"concat('CASS', {_piece('b', f'{n} % 9', '1', f'4 + {n} % 2')}, {_piece('y', f'{k} % 60', '1', f'1 + {k} % 2')}, 'EQYF')"
    va, ja = f"concat('TRAV', 1 + {n} % 25, '*01')", f"concat('TRAJ', 1 + {k} % 12, '*01')"
    vb, jb = f"concat('TRBV', 1 + ({n} * 7 + {k} % 2) % 25, '*01')", f"concat('TRBJ', 1 + {n} % 2, '-', 1 + {k} % 3, '*01')"
    return {
        "id": f"cast({k} as bigint)", "va": va, "ja": ja, "cdr3a": a, "vb": vb, "jb": jb, "cdr3b": b,
        "ag": f"concat({va}, '|', {ja}, '|', {a})", "bg": f"concat({vb}, '|', {jb}, '|', {b})",
        "cg": f"cast({n} % 5 as bigint)", "ct": f"cast(({n} + {k}) % 4 as bigint)", "clone_size": f"cast(1 + {k} % 7 as bigint)",
    }


def receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, two chains (V, J, CDR3), exclusion groups, clusters and clone size, one of each customer."""
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} as {c}" for c, e in receptor_columns("c_custkey", "c_nationkey").items()))


def receptor_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receptors as above, one of each supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(*(f"{e} as {c}" for c, e in receptor_columns("s_suppkey", "s_nationkey").items()))


def gene_columns(n: str, ab: str) -> dict[str, str]:
    """A V gene with aligned loops: families of five nations share all but two places."""
    letters = "ACDEFGHIKLMNPQ*."
    part = lambda first, size: _piece(f"c{ab}", f"{n} % 5", first, size, letters)
    return {"gene": f"concat('TR{ab}V', 1 + {n}, '*01')", "chain": f"'{ab}'", "loops": f"concat({part('1', '5')}, ' ', {_piece(f'd{ab}', n, '1', '2', letters)}, {part('6', '3')}, ' ', {part('9', '4')})"}


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, chain, loops: an A and a B gene of each nation."""
    n = table(spark, sf_dir, "nation")
    a, b = (n.selectExpr(*(f"{e} as {c}" for c, e in gene_columns("n_nationkey", ab).items())) for ab in "AB")
    return a.unionByName(b)


def junction_genes(spark: SparkSession, sf_dir: str, chain: str = "B") -> DataFrame:
    """gene, chain, region, nuc: V and J genes of each nation, with a second allele of every fifth V gene
    that differs in one base, and for chain B the two D genes."""
    tag = "" if chain == "B" else chain.lower()
    bases = lambda tag, k: f"translate(md5(concat('{tag}', {k})), '0123456789abcdef', 'acgtacgtacgtacgt')"
    n = table(spark, sf_dir, "nation")
    v = n.selectExpr(f"concat('TR{chain}V', 1 + n_nationkey, '*01') as gene", "'V' as region", f"concat('tgtgccagc', substr({bases(tag + 'v', 'n_nationkey')}, 1, 12)) as nuc")
    other = v.where("pmod(xxhash64(gene), 5) = 0").selectExpr("replace(gene, '*01', '*02') as gene", "region", "concat(substr(nuc, 1, 9), translate(substr(nuc, 10, 1), 'acgt', 'cgta'), substr(nuc, 11)) as nuc")
    j = n.selectExpr(f"concat('TR{chain}J', 1 + n_nationkey, '*01') as gene", "'J' as region", f"concat(substr({bases(tag + 'j', 'n_nationkey')}, 1, 12), 'tatacattc') as nuc")
    if chain != "B":
        return v.unionByName(other).unionByName(j).withColumn("chain", F.lit(chain))
    d = spark.createDataFrame([("TRBD1*01", "D", "gggacagggggc"), ("TRBD2*01", "D", "gggactagcggggggg")], "gene string, region string, nuc string")
    return v.unionByName(other).unionByName(j).unionByName(d).withColumn("chain", F.lit("B"))


def junction_chains(spark: SparkSession, sf_dir: str, chain: str = "B") -> DataFrame:
    """id, v, j, cdr3, nt, chain: one of each customer, the front of a V gene, some bases or a part of a D
    gene, and the back of a J gene; those with a stop codon are left out."""
    from bispace.functions.scores import translate

    genes_ = junction_genes(spark, sf_dir, chain)
    c = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", f"concat('TR{chain}V', 1 + c_nationkey, '*01') as v", f"concat('TR{chain}J', 1 + (c_nationkey * 3 + c_custkey) % 25, '*01') as j", "cast(9 + c_custkey % 7 as int) as a", "cast(12 + c_custkey % 5 as int) as c")
    c = c.join(genes_.selectExpr("gene as v", "nuc as vn"), "v").join(genes_.selectExpr("gene as j", "nuc as jn"), "j")
    middle = F.expr("substr(if(id % 2 = 0, 'gacagggggcaa', translate(md5(concat('m', id)), '0123456789abcdef', 'acgtacgtacgtacgt')), 1, 6 + (3 - (a + c) % 3) % 3)")
    nt = F.concat(F.expr("substr(vn, 1, a)"), middle, F.expr("substr(jn, -c)"))
    rows = c.select("id", "v", "j", nt.alias("nt"), F.lit(chain).alias("chain"))
    return rows.withColumn("cdr3", translate(F.col("nt"))).where(~F.col("cdr3").contains("*")).select("id", "v", "j", "cdr3", "nt", "chain")
