"""Versioned state: hash-chained logs, generation rules, recovery and required chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records that a slot of a log takes, bytes of a name.
SLOT_RECORDS, MAX_NAME = 64, 255


#: What a commit record carries of its namespace; none may step back.
CURSORS = ("mutation_cutoff", "reservation_end", "allocation_cursor")


def decode_log(log: DataFrame) -> DataFrame:
    """Adds valid (the record belongs to the unbroken prefix of its log) and fault (why it breaks, null if it does not by itself).

    A record must be whole (``torn`` is false, where that column is there) and have a good checksum, follow its predecessor's generation by one, name
    its hash, and none of the three cursors may step back.
    """
    by = Window.partitionBy("log_id").orderBy("position")
    first = F.col("position") == F.min("position").over(Window.partitionBy("log_id"))
    torn = F.col("torn") if "torn" in log.columns else F.lit(False)
    back = F.lit(False)
    for cursor in [c for c in CURSORS if c in log.columns]:
        back = back | F.coalesce(F.col(cursor) < F.lag(cursor).over(by), F.lit(False))
    fault = (
        F.when(torn, "TORN")
        .when(~F.col("checksum_ok"), "INVALID_RECORD")
        .when(first, F.lit(None))
        .when(F.col("generation") != F.lag("generation").over(by) + 1, "BROKEN_CHAIN")
        .when(~F.col("previous_hash").eqNullSafe(F.lag("record_hash").over(by)), "BROKEN_CHAIN")
        .when(back, "BROKEN_CHAIN")
    )
    marked = log.withColumn("fault", fault)
    broken = F.max(F.col("fault").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("valid", broken == 0)


def log_tail(log: DataFrame) -> DataFrame:
    """(log_id, records, valid_records, last_generation, tail) of each log."""
    marked = decode_log(log)
    first_fault = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position")))
    return marked.groupBy("log_id").agg(
        F.count("*").alias("records"),
        F.count_if("valid").alias("valid_records"),
        F.max(F.when(F.col("valid"), F.col("generation"))).alias("last_generation"),
        F.coalesce(first_fault, F.lit("CLEAN")).alias("tail"),
    )


def select_slot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which of two slots of a log is current: a and b are tails (log_id, first_generation, last_generation, records, last_hash, first_hash
    [, bytes_hash, tail]).

    A slot without records must be clean, else the log is BROKEN. Equal last generations must agree; then the longer slot wins, slots of one length
    must have the same bytes, and A wins if its tail is clean. A newer slot must begin with the older one's last record.
    """
    for c, default in (("bytes_hash", F.lit("")), ("tail", F.lit("CLEAN"))):
        a = a if c in a.columns else a.withColumn(c, default)
        b = b if c in b.columns else b.withColumn(c, default)
    x = a.select("log_id", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "log_id"])
    y = b.select("log_id", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "log_id"])
    empty = lambda s: F.coalesce(F.col(f"{s}_records"), F.lit(0)) == 0
    broken = lambda s: empty(s) & (F.coalesce(F.col(f"{s}_tail"), F.lit("CLEAN")) != "CLEAN")
    alike = (
        F.when(F.col("a_last_hash") != F.col("b_last_hash"), "CONFLICT")
        .when(F.col("a_records") != F.col("b_records"), F.when(F.col("a_records") > F.col("b_records"), "A").otherwise("B"))
        .when(F.col("a_bytes_hash") != F.col("b_bytes_hash"), "CONFLICT")
        .otherwise(F.when(F.col("a_tail") == "CLEAN", "A").otherwise("B"))
    )
    choice = (
        F.when(broken("a") | broken("b"), "BROKEN")
        .when(empty("a") & empty("b"), "NONE")
        .when(empty("b"), "A")
        .when(empty("a"), "B")
        .when(F.col("a_last_generation") == F.col("b_last_generation"), alike)
        .when(F.col("a_last_generation") > F.col("b_last_generation"), F.when(F.col("a_first_hash") == F.col("b_last_hash"), "A").otherwise("CONFLICT"))
        .otherwise(F.when(F.col("b_first_hash") == F.col("a_last_hash"), "B").otherwise("CONFLICT"))
    )
    return x.join(y, "log_id", "full_outer").select("log_id", choice.alias("slot"))


def successor_faults(log: DataFrame, new: DataFrame) -> DataFrame:
    """(log_id, fault) of records (log_id and a record's columns) that do not continue their log: BROKEN_CHAIN, null if they do.

    The first record of a log has generation 1 and no previous hash; any other follows the last one's generation by one, names its hash
    and steps back with no cursor.
    """
    last = log.groupBy("log_id").agg(F.max_by(F.struct("generation", "record_hash", *CURSORS), "position").alias("l"))
    back = F.lit(False)
    for cursor in CURSORS:
        back = back | (F.col(cursor) < F.col(f"l.{cursor}"))
    follows = (F.col("generation") == F.col("l.generation") + 1) & F.col("previous_hash").eqNullSafe(F.col("l.record_hash")) & ~back
    first = (F.col("generation") == 1) & F.col("previous_hash").isNull()
    good = F.when(F.col("l").isNull(), first).otherwise(follows)
    return new.join(last, "log_id", "left").select("log_id", F.when(~good, "BROKEN_CHAIN").alias("fault"))


def rotate(log: DataFrame, most: int = SLOT_RECORDS) -> DataFrame:
    """Adds slot and slot_position: a log's records dealt to two slots in turn. A slot takes ``most`` records; the next begins with a copy of the last record, the
    bridge, and goes on with what follows, so each turn takes ``most`` - 1 new records."""
    place = F.row_number().over(Window.partitionBy("log_id").orderBy("position")) - 1
    turn = F.when(place == 0, 0).otherwise(F.floor((place - 1) / (most - 1)))
    rows = log.withColumn("turn", turn.cast("long")).withColumn("slot_position", F.when(place == 0, 0).otherwise((place - 1) % (most - 1) + 1).cast("long"))
    last = Window.partitionBy("log_id")
    bridges = rows.withColumn("end", F.max("turn").over(last)).where((F.col("slot_position") == most - 1) & (F.col("turn") < F.col("end"))).drop("end")
    bridges = bridges.withColumn("turn", F.col("turn") + 1).withColumn("slot_position", F.lit(0).cast("long"))
    return rows.unionByName(bridges).withColumn("slot", F.when(F.col("turn") % 2 == 0, "A").otherwise("B"))


def transition_faults(roots: DataFrame, inodes: DataFrame) -> DataFrame:
    """(generation, fault, inode): what a generation's root (generation, mutation_sequence, reservation_end, allocation_cursor) or inodes
    (generation, inode, mutation_sequence) may not do after the generation before it. The six rules in their order: no cursor steps back, allocation
    stays within the reservation that was durable before, an inode's sequence does not step back, and a new inode has an id that was never given out."""
    by = Window.orderBy("generation")  # one row for each generation
    before = roots.select("generation", *[F.lag(c).over(by).alias(f"p_{c}") for c in ("generation", "mutation_sequence", "reservation_end", "allocation_cursor")])
    both = roots.join(before, "generation").where("p_generation IS NOT NULL")
    rules = {
        "MUTATION_BACK": F.col("mutation_sequence") < F.col("p_mutation_sequence"),
        "RESERVATION_BACK": F.col("reservation_end") < F.col("p_reservation_end"),
        "ALLOCATION_BACK": F.col("allocation_cursor") < F.col("p_allocation_cursor"),
        "BEYOND_RESERVATION": F.col("allocation_cursor") > F.col("p_reservation_end"),
    }
    of_root = both.select("generation", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("fault"), F.lit(None).cast("long").alias("inode"))
    now = inodes.join(both.select("generation", "p_generation", F.col("p_allocation_cursor").alias("given")), "generation")
    past = inodes.select(F.col("generation").alias("p_generation"), "inode", F.col("mutation_sequence").alias("was"))
    fault = F.when(F.col("was").isNull(), F.when(F.col("inode") < F.col("given"), "REUSED_INODE")).when(F.col("mutation_sequence") < F.col("was"), "INODE_BACK")
    of_inode = now.join(past, ["p_generation", "inode"], "left").select("generation", fault.alias("fault"), "inode").where("fault IS NOT NULL")
    return of_root.unionByName(of_inode)


def valid_prefix(roots: DataFrame, inodes: DataFrame) -> DataFrame:
    """Generations of the longest prefix in which no transition has a fault; a first generation must be empty (cursor 2, no inode)."""
    first = roots.where("generation = 1").join(inodes.select("generation").distinct().withColumn("some", F.lit(True)), "generation", "left")
    bad = first.where("allocation_cursor <> 2 OR some").select("generation")
    bad = bad.unionByName(transition_faults(roots, inodes).select("generation")).agg(F.min("generation").alias("bad"))
    return roots.join(F.broadcast(bad)).where("bad IS NULL OR generation < bad").select("generation")  # one row


def root_faults(roots: DataFrame, inodes: DataFrame) -> DataFrame:
    """(generation, fault): reservation and cursor of at least 2, the cursor within the reservation, inodes below the cursor, each id once."""
    highest = inodes.groupBy("generation").agg(F.max("inode").alias("highest"), (F.count("*") != F.countDistinct("inode")).alias("twice"))
    both = roots.join(highest, "generation", "left")
    rules = {
        "RESERVATION": F.col("reservation_end") < 2,
        "CURSOR": (F.col("allocation_cursor") < 2) | (F.col("allocation_cursor") > F.col("reservation_end")),
        "INODE_BEYOND_CURSOR": F.col("highest") >= F.col("allocation_cursor"),
        "INODE_TWICE": F.coalesce("twice", F.lit(False)),
    }
    return both.select("generation", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("fault"))


def name_faults(names: DataFrame, root: int = 1) -> DataFrame:
    """(parent, name, target, fault): names that are empty, too long, '.' or '..', hold a slash or a zero, hang elsewhere than in the root, point to
    the root or stand twice."""
    long = F.octet_length("name") > MAX_NAME
    text = (F.col("name") == "") | long | F.col("name").isin(".", "..") | F.col("name").contains("/") | F.col("name").contains("\0")
    twice = F.count("*").over(Window.partitionBy("parent", "name")) > 1
    fault = F.when(text, "NAME").when(F.col("parent") != root, "PARENT").when(F.col("target") <= root, "TARGET").when(twice, "TWICE")
    return names.select("parent", "name", "target", fault.alias("fault")).where("fault IS NOT NULL")


def recoverable(generations: DataFrame, required: DataFrame, locations: DataFrame) -> DataFrame:
    """The newest of the last two generations (column generation) whose required chunks all have a location; one row, null if neither."""
    last = generations.agg(F.max("generation").alias("m"))
    tried = generations.join(F.broadcast(last), F.col("generation") >= F.col("m") - 1).select("generation").distinct()
    lost = required.join(locations.select("chunk_id", "logical_length"), ["chunk_id", "logical_length"], "left_anti").select("generation").distinct()
    return tried.join(lost, "generation", "left_anti").agg(F.max("generation").alias("generation"))


def namespace_faults(inodes: DataFrame, names: DataFrame) -> DataFrame:
    """(inode, fault): names without an inode and link counts that are not the number of names."""
    count = names.groupBy(F.col("target").alias("inode")).agg(F.count("*").alias("names"))
    both = inodes.select("inode", "link_count").join(count, "inode", "full_outer")
    fault = F.when(F.col("link_count").isNull(), "DANGLING").when(F.col("link_count") != F.coalesce("names", F.lit(0)), "LINK_COUNT")
    return both.select("inode", fault.alias("fault")).where("fault IS NOT NULL")


def required_set(extents: DataFrame) -> DataFrame:
    """Distinct chunks that DATA and SLICE extents need whole."""
    return extents.where("kind IN ('DATA', 'SLICE')").select("chunk_id", F.col("chunk_length").alias("logical_length")).distinct()


def online_set(required: DataFrame, keep: int = 2) -> DataFrame:
    """Distinct chunks of the last ``keep`` generations that exist."""
    last = required.select("generation").distinct().orderBy(F.col("generation").desc()).limit(keep)
    return required.join(F.broadcast(last), "generation").select("chunk_id", "logical_length").distinct()  # keep rows


def new_requirements(required: DataFrame) -> DataFrame:
    """(generation, chunk_id, logical_length) that a generation needs and no earlier one did."""
    return required.groupBy("chunk_id", "logical_length").agg(F.min("generation").alias("generation"))


def plan_is_current(planned: DataFrame, log: DataFrame) -> DataFrame:
    """(current): whether the last two records (generation, record_hash) of a log are still those of a plan."""
    last = log.orderBy(F.col("generation").desc()).limit(2).select("generation", "record_hash")
    off = last.exceptAll(planned.select("generation", "record_hash")).count() + planned.select("generation", "record_hash").exceptAll(last).count()
    return log.sparkSession.createDataFrame([(off == 0,)], "current boolean")
