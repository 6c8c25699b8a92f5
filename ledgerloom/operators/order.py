"""The order of scanned pages by their printed cumulative totals: a candidate, its witnesses and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import chain, footers

MONEY = "decimal(18,2)"


def candidate_order(pages: DataFrame) -> DataFrame:
    """``pages`` (statement, pos, debits, credits) with the places that their totals give them.

    file_place: from 1 in order of pos. place: pages with both totals by debits, credits, pos; a page that lacks one stays
    behind its predecessor in the file (``unplaced``), at the very front if it has none. conflict: credits fall from the
    page before to this one; duplicate: another page has the same totals.
    """
    file = Window.partitionBy("statement").orderBy("pos")
    ranks = Window.partitionBy("statement", "unplaced").orderBy("debits", "credits", "pos")
    same = Window.partitionBy("statement", "unplaced", "debits", "credits")
    rows = pages.withColumn("unplaced", F.col("debits").isNull() | F.col("credits").isNull())
    rows = rows.withColumns({"_rank": F.when(~F.col("unplaced"), F.row_number().over(ranks)), "conflict": ~F.col("unplaced") & F.coalesce(F.col("credits") < F.lag("credits").over(ranks), F.lit(False)), "duplicate": ~F.col("unplaced") & (F.count("*").over(same) > 1)})
    behind = F.coalesce(F.last("_rank", ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumns({"file_place": F.row_number().over(file), "_behind": behind})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("statement").orderBy("_behind", "pos"))).drop("_rank", "_behind")


def moved(ordered: DataFrame) -> DataFrame:
    """``ordered`` with moved: the fewest pages whose move turns the file's order into that of the places.

    They stand off one longest run in which file_place rises with place. Where the first k places hold the first k pages
    of the file, the order is cut: runs on both sides add up, so only the pages between two cuts are looked at together,
    and pages between adjacent cuts stay.
    """
    by_place = Window.partitionBy("statement").orderBy("place")
    upto, before = by_place.rowsBetween(Window.unboundedPreceding, 0), by_place.rowsBetween(Window.unboundedPreceding, -1)
    rows = ordered.withColumn("_closed", F.max("file_place").over(upto) == F.col("place"))
    rows = rows.withColumn("_block", F.coalesce(F.sum(F.col("_closed").cast("int")).over(before), F.lit(0)))
    others = [c for c in ordered.columns if c not in ("statement", "place")]
    blocks = rows.groupBy("statement", "_block").agg(F.array_sort(F.collect_list(F.struct("place", *others))).alias("_pages"))
    run = longest_run(F.transform("_pages", lambda p: p.file_place))
    blocks = blocks.withColumn("_keep", F.when(F.size("_pages") > 1, run).otherwise(F.array(F.lit(True))))
    out = blocks.select("statement", F.explode(F.arrays_zip("_pages", "_keep")).alias("_x"))
    return out.select(*["statement" if c == "statement" else F.col(f"_x._pages.{c}") for c in ordered.columns], (~F.col("_x._keep")).alias("moved"))


def longest_run(ranks: Column) -> Column:
    """array<boolean>: which of the distinct ``ranks`` belong to one longest rising run, as ``footers.fewest_moved`` chooses it."""
    none = F.array().cast("array<int>")

    def put(a: Column, rank: Column) -> Column:
        """ends: by length the smallest rank that ends a run so long; lengths: of the longest run that ends at each rank."""
        shorter = F.size(F.filter(a.ends, lambda e: e < rank))
        ends = F.concat(F.slice(a.ends, 1, shorter), F.array(rank), F.slice(a.ends, shorter + 2, F.size(a.ends)))
        return F.struct(ends.alias("ends"), F.array_append(a.lengths, shorter + 1).alias("lengths"))

    def back(a: Column, length: Column) -> Column:
        hit = length == a.need
        return F.struct((a.need - hit.cast("int")).alias("need"), F.array_append(a.keep, hit).alias("keep"))

    def chosen(a: Column) -> Column:
        start = F.struct(F.size(a.ends).alias("need"), F.array().cast("array<boolean>").alias("keep"))
        return F.reverse(F.aggregate(F.reverse(a.lengths), start, back, lambda b: b.keep))

    return F.aggregate(ranks, F.struct(none.alias("ends"), none.alias("lengths")), put, chosen)


def own_sums(rows: DataFrame, ordered: DataFrame, places: dict[str, str]) -> DataFrame:
    """``ordered`` with the debits and credits of each page's rows, chained in the order of each of ``places``.

    places: by column of ``ordered``, what its sums' names begin with (own: own_debits, own_credits), null for a page
    without rows. rows: statement, pos, row_no, description, movement, balance; a pos stands for one page. Pages and rows
    are put into one table and told apart by grouping, so that all of it stays with the statement's task and neither is
    worked out twice, as a join by pos would do.
    """
    given = [c for c in ordered.columns if c not in ("statement", "pos")]
    heads = ordered.select("statement", "pos", *[F.col(c).alias(f"_p_{c}") for c in given])
    rows = rows.where("statement IS NOT NULL AND pos IS NOT NULL").select("statement", "pos", "row_no", "description", "movement", "balance", F.lit(True).alias("_row"))
    lines, here = heads.unionByName(rows, allowMissingColumns=True), Window.partitionBy("statement", "pos")
    lines = lines.withColumns({c: F.coalesce(f"_p_{c}", F.max(f"_p_{c}").over(here)) for c in places}).where(F.col(next(iter(places))).isNotNull())
    # a page's own line has no balance and stands behind its rows, so the chain passes over it
    within = F.when(F.col("_row"), F.coalesce("row_no", F.lit(-(2**31)))).otherwise(F.lit(2**31))
    sums = {}
    for place, name in places.items():
        lines = chain.derive(lines.withColumns({"page": F.col(place), "seq": F.col(place).cast("long") * 2**32 + within}))
        lines = lines.withColumns({f"_{name}_{s}s": footers.of_side(s) for s in ("debit", "credit")}).drop("boundary", "opening", "derived", "side", "ok", "scale_fixed")
        sums |= {f"{name}_{s}": F.when(F.count("_row") > 0, F.coalesce(F.sum(f"_{name}_{s}"), F.lit(0)).cast(MONEY)) for s in ("debits", "credits")}
    kept = {c: F.first(f"_p_{c}", ignorenulls=True) for c in given if c not in places}
    out = lines.groupBy("statement", "pos", *places).agg(*[c.alias(n) for n, c in (kept | sums).items()])
    return out.select(*ordered.columns, *sums)


def relations(pages: DataFrame) -> DataFrame:
    """``pages`` with relation to the page at the place before: adjacent, gap, mismatch or undecided; null for the first.

    pages: statement, place, debits, credits, own_debits, own_credits, number (printed, null where not read). The step of
    both totals that equals the page's own sums outranks the numbers; a jump of numbers is a gap; what disagrees otherwise
    is a mismatch, and without all totals undecided.
    """
    return pages.withColumn("relation", footers.relation(Window.partitionBy("statement").orderBy("place"), F.col("number")))


def witnessed(number: Column, before: Column, after: Column) -> Column:
    """Whether a printed number lies between those of its neighbours, of which one is known at least."""
    known = number.isNotNull() & (before.isNotNull() | after.isNotNull())
    return known & F.coalesce(before < number, F.lit(True)) & F.coalesce(number < after, F.lit(True))


def candidates(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """``pages`` with the candidate's places, moved, relation and witness, and sums of their rows in its order (own) and the file's (file)."""
    ordered = relations(own_sums(rows, moved(candidate_order(pages)), {"place": "own", "file_place": "file"}))
    by_place = Window.partitionBy("statement").orderBy("place")
    near = (F.col("relation") == "adjacent") | (F.lead("relation").over(by_place) == "adjacent")
    numbers = witnessed(F.col("number"), F.lag("number").over(by_place), F.lead("number").over(by_place))
    return ordered.withColumn("witness", F.coalesce(near, F.lit(False)) | F.coalesce(numbers, F.lit(False)))


def reason_against(conflict: Column, duplicate: Column, lone: Column) -> Column:
    return F.when(conflict, "conflict").when(duplicate, "duplicate").when(lone, "lone")


def in_order(ordered: DataFrame) -> DataFrame:
    """``candidates`` with order: the candidate's place where it is applied to the statement, else the file's."""
    whole = Window.partitionBy("statement")
    some = lambda c: F.coalesce(F.max(c).over(whole), F.lit(False))
    rows = ordered.where("statement IS NOT NULL")
    applied = some(F.col("moved")) & reason_against(some(F.col("conflict")), some(F.col("duplicate")), some(F.col("moved") & ~F.col("witness"))).isNull()
    rows = rows.withColumn("applied", applied)
    return rows.withColumn("order", F.when(F.col("applied"), F.col("place")).otherwise(F.col("file_place")))


def decide_order(pages: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decision for each statement, and the pages in the order to be worked on.

    pages: statement, pos, debits, credits (cumulative, null where not read), number (printed, null where not read);
    rows: statement, pos, row_no, description, movement, balance. First: statement, pages, unplaced, moved, applied,
    reason (conflict, duplicate, lone; null where the candidate holds or changes nothing), lone (up to five positions of
    moved pages without a second witness, by place). Second: statement, pos, place, number, relation, moved, witness, order.

    A misread digit moves a page far, so the candidate is applied only without conflicts and duplicates and if each moved
    page has a witness beside the totals: a neighbour that is adjacent by arithmetic, or printed numbers on both sides of its own.
    """
    ordered = candidates(pages, rows)
    by_place = Window.partitionBy("statement").orderBy("place")
    flag = lambda c: F.coalesce(F.max(c), F.lit(False))
    lone = F.col("moved") & ~F.col("witness")
    kth = F.sum(lone.cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    facts = ordered.withColumns({"_lone": lone, "_kth": kth}).groupBy("statement").agg(F.count("*").alias("pages"), F.count_if("unplaced").alias("unplaced"), F.count_if("moved").alias("moved"), flag("conflict").alias("_conflict"), flag("duplicate").alias("_duplicate"), F.count_if("_lone").alias("_n_lone"), F.array_sort(F.collect_list(F.when(F.col("_lone") & (F.col("_kth") <= 5), F.struct("place", "pos")))).alias("_some"))
    changed = F.col("moved") > 0
    facts = facts.withColumn("reason", reason_against(F.col("_conflict"), F.col("_duplicate"), F.col("_n_lone") > 0)).withColumn("applied", changed & F.col("reason").isNull())
    decided = facts.select("statement", "pages", "unplaced", "moved", "applied", "reason", F.when(F.col("reason") == "lone", F.col("_some.pos")).otherwise(F.array().cast("array<int>")).alias("lone"))
    return decided, in_order(ordered).select("statement", "pos", "place", "number", "relation", "moved", "witness", "order")


def decided_relations(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """statement, pos, place (the decided order), relation (measured in that order), of the same pages and rows as ``decide_order``."""
    ordered = in_order(candidates(pages, rows))
    own = [F.when(F.col("applied"), F.col(f"own_{s}")).otherwise(F.col(f"file_{s}")).alias(f"own_{s}") for s in ("debits", "credits")]
    placed = ordered.select("statement", "pos", F.col("order").alias("place"), "number", "debits", "credits", *own)
    return relations(placed).select("statement", "pos", "place", "relation")
