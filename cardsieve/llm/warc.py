"""WARC archives: written as plain files, read back by boundary-chain verification.

Spark's text sink writes a record's bytes as they are, and its text source cuts a file at
the record magic, split by split. Every piece behind a magic that has a header with a
length is a candidate: it claims where the next record begins. Magic inside a payload makes
candidates too. Only records on the chain of claims that starts at the head of the file
are real. Inside a split, runs of candidates that point at each other in turn are drawn
together; over what is left, pointers jump twice as far each round.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardsieve.llm.bit_table import with_flag
from cardsieve.llm.common import keep

MAGIC = "WARC/1.1\r\n"
LEAST_REVISIT_BYTES = 1000
_PLACE = ["file", "block", "row"]


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, refers_to) of each page.

    refers_to is the largest page_id among pages of equal payload, for all others of them,
    whose html is null here: a revisit has none. Null html is an empty payload. A page without
    page_id is never a revisit, nor referred to; rows that repeat the largest page_id are all
    responses.

    Pages are decided without their html. Then the html of most is taken straight from the
    scan; only that of the one response of each repeated payload is shuffled.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce("url", F.lit("")).alias("url"),
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    light = keep(own.drop("html"), "digests")
    large = light.where(F.col("payload_bytes") >= least)
    shared = keep(
        large.groupBy("payload_digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 AND last IS NOT NULL")
        .select("payload_digest", "last"),
        "shared",
    )
    revisits = large.join(shared, "payload_digest").where("page_id < last").select(
        "page_id",
        "url",
        F.lit(None).cast("string").alias("html"),
        "payload_digest",
        "payload_bytes",
        F.col("last").alias("refers_to"),
    )

    def flagged(df: DataFrame) -> DataFrame:
        taken = shared.select(F.xxhash64("payload_digest").alias("key"))
        key = F.when(F.col("payload_bytes") >= least, F.xxhash64("payload_digest"))
        return with_flag(df, key, taken, "repeats")

    # Of the pages that may repeat: the responses, by digest and page.
    pair = ["payload_digest", "page_id"]
    responses = flagged(large).where("repeats AND page_id IS NOT NULL")
    responses = responses.join(shared, "payload_digest", "left").where(
        "last IS NULL OR page_id >= last"
    )
    wanted = keep(responses.select(*pair).distinct(), "wanted")
    found = flagged(own)
    straight = found.where("NOT repeats OR page_id IS NULL").drop("repeats")
    several = with_flag(
        found.where("repeats AND page_id IS NOT NULL").drop("repeats"),
        F.xxhash64(*pair),
        wanted.select(F.xxhash64(*pair).alias("key")),
        "may_be",
    )
    several = several.where("may_be").drop("may_be").join(wanted, pair, "left_semi")
    no_target = F.lit(None).cast("long").alias("refers_to")
    return (
        straight.select("*", no_target)
        .unionByName(several.select("*", no_target))
        .unionByName(revisits)
    )


def _record(page: DataFrame) -> Column:
    """One record without its last line end. Header values never hold a line end."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    header = F.concat_ws(
        "\r\n",
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Refers-To", name("refers_to")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", length.cast("string")),
    )
    body = F.when(revisit, "").otherwise(F.col("html"))
    return F.concat(F.lit(MAGIC), header, F.lit("\r\n\r\n"), body, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, records_per_file: int = 20_000) -> str:
    """Write every page as a record; files hold at most `records_per_file` of them."""
    plan_revisits(pages).select(_record(pages).alias("value")).write.option(
        "lineSep", "\r\n"
    ).option("maxRecordsPerFile", records_per_file).text(path)
    return path


def _field(header: str, label: str, value: str) -> Column:
    return F.regexp_extract(header, rf"(?i)(?:^|\r\n){label}: *({value})(?=\r\n|$)", 1)


def _name(label: str) -> Column:
    return F.regexp_extract("header", rf"(?i)(?:^|\r\n){label}: *<urn:page:(-?\d+)>(?=\r\n|$)", 1)


def _number(text: Column) -> Column:
    return F.when(text != "", text).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, in order inside each split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def _candidates(pieces: DataFrame) -> DataFrame:
    """Pieces with what their headers say, and where they begin in the file."""
    own = F.expr("instr(value, '\r\n\r\n') > 0")
    found = pieces.select(
        *_PLACE,
        F.octet_length("value").cast("long").alias("size"),
        F.when(own, F.substring_index("value", "\r\n\r\n", 1)).alias("header"),
        F.md5(F.col("value").cast("binary")).alias("mark"),
        F.col("value").cast("binary").alias("bytes"),
    ).select(
        *_PLACE,
        "size",
        "mark",
        F.octet_length("header").cast("long").alias("head"),
        _number(_field("header", "Content-Length", r"\d{1,15}")).alias("length"),
        _number(_name("WARC-Record-ID")).alias("page_id"),
        _number(_name("WARC-Refers-To")).alias("refers_to"),
        _field("header", "WARC-Type", "[a-z]+").alias("record_type"),
        _number(_field("header", "WARC-Payload-Length", r"\d{1,15}")).alias("claimed_bytes"),
        _field("header", "WARC-Payload-Digest", "sha1:[0-9a-f]+").substr(6, 40).alias("claimed_digest"),
        "bytes",
    )
    whole = F.col("length") <= F.col("size") - F.col("head") - 4
    content = F.expr("substring(bytes, CAST(head + 5 AS INT), CAST(length AS INT))")
    found = found.withColumn("digest", F.when(whole, F.sha1(content))).drop("bytes")
    found = keep(found, "candidates")

    inside = Window.partitionBy("file", "block").orderBy("row")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    order = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("base"))
    before = F.sum(F.col("size") + len(MAGIC)).over(inside) - F.col("size") - len(MAGIC)
    placed = found.withColumn("before", before).join(blocks, ["file", "block"])
    start = F.col("before") + F.col("base") - len(MAGIC)
    return placed.withColumn("start", start).drop("before", "base")


def _on_chain(candidates: DataFrame) -> DataFrame:
    """(file, start) of the candidates that the chain from the head of each file reaches."""
    claim = F.col("start") + len(MAGIC) + F.col("head") + 4 + F.col("length") + 4
    inside = Window.partitionBy("file", "block").orderBy("start")
    claims = (
        candidates.where("length IS NOT NULL AND start >= 0")
        .select("file", "block", "start", claim.alias("next"))
        .withColumn("adjacent", F.coalesce(F.col("next") == F.lead("start").over(inside), F.lit(False)))
    )
    claims = keep(claims, "claims")
    targets = claims.where(~F.col("adjacent")).select(
        "file", F.col("next").alias("start"), F.lit(True).alias("aimed")
    ).distinct()
    led = F.lag("adjacent").over(inside)
    claims = claims.join(targets, ["file", "start"], "left").withColumn(
        "is_head", ~F.coalesce(led, F.lit(False)) | F.col("aimed").isNotNull()
    )
    run = F.max(F.when(F.col("is_head"), F.col("start"))).over(inside)
    claims = keep(claims.select("file", "start", "next", run.alias("run")), "claims")
    jumps = claims.groupBy("file", "run").agg(F.max_by("next", "start").alias("to"))
    real = jumps.select("file", F.col("run").alias("to"))
    jumps = keep(jumps.join(real, ["file", "to"], "left_semi"), "jumps")
    reached = claims.where("start = 0").select("file", "run")
    while not jumps.isEmpty():
        step = jumps.join(reached, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = keep(reached.union(step).distinct(), "reached")
        two = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("far"))
        jumps = jumps.join(two, ["file", "to"]).select("file", "run", F.col("far").alias("to"))
        jumps = keep(jumps, "jumps")
    return claims.join(reached, ["file", "run"]).select("file", "start")


def _split_payloads(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """(file, start, digest) of records whose payload holds magic and so lies in several pieces."""
    per_file = Window.partitionBy("file").orderBy("start")
    owner = F.max(F.when(F.col("real"), F.col("start"))).over(per_file)
    split = F.max(F.when(F.col("real"), F.struct("start", F.col("digest").isNull().alias("open")))).over(per_file)
    wanted = pieces.select("file", "start", "size", "mark", owner.alias("owner"), split["open"].alias("open"), "real", "head", "length")
    wanted = keep(wanted.where("open"), "wanted")
    # The archive is read again, and pieces are known by content: how files are split among
    # tasks may have changed since.
    marks = wanted.select("size", "mark").distinct()
    again = _pieces(spark, path).select(
        F.octet_length("value").cast("long").alias("size"),
        F.md5(F.col("value").cast("binary")).alias("mark"),
        "value",
    )
    again = with_flag(
        again,
        F.xxhash64("size", "mark"),
        marks.select(F.xxhash64("size", "mark").alias("key")),
        "may_be",
    )
    again = again.where("may_be").groupBy("size", "mark").agg(F.first("value").alias("value"))
    texts = wanted.join(again, ["size", "mark"])
    # A record is as long as its writer made it; its pieces meet in one row again.
    gathered = texts.groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "value"))).alias("pieces"),
        F.max(F.when(F.col("real"), F.col("head"))).alias("head"),
        F.max(F.when(F.col("real"), F.col("length"))).alias("length"),
    )
    joined = F.array_join(F.col("pieces.value"), MAGIC).cast("binary")
    content = F.expr("substring(bytes, CAST(head + 5 AS INT), CAST(length AS INT))")
    return gathered.withColumn("bytes", joined).select(
        "file", F.col("owner").alias("start"), F.sha1(content).alias("joined_digest")
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and size of a response are those of the bytes that were read; a revisit has them
    from its header. An archive without records gives an empty result.
    """
    pieces = _candidates(_pieces(spark, path))
    real = _on_chain(pieces).withColumn("real", F.lit(True))
    pieces = pieces.join(real, ["file", "start"], "left").withColumn(
        "real", F.coalesce("real", F.lit(False))
    )
    pieces = keep(pieces, "pieces")
    records = pieces.where("real")
    if not records.where("digest IS NULL").isEmpty():
        joined = _split_payloads(spark, path, pieces)
        records = records.join(joined, ["file", "start"], "left").withColumn(
            "digest", F.coalesce("digest", "joined_digest")
        )
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        F.when(revisit, F.col("claimed_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("claimed_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
