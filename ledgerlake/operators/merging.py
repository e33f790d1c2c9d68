"""Which runs are admitted, and the history that their exports make together.

Whether a run is admitted depends on which earlier runs of its account are. Nothing
else couples an account's dates, so all runs are first assumed to be admitted, and
every run is judged against the earlier ones under that assumption, identity by
identity and date by date, with windows that hold one row for each run. Where the
verdicts aren't what was assumed, they are the next assumption. The first run of an
account that was assumed wrongly has its final verdict, so each round settles one at
least; accounts whose verdicts are as assumed are done. An account's records are
never together in a task.

What all runs of a date show alike can't be missing, and is new only to the first of
them that is admitted: of these identities rounds read one sum a date.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_parts, identity_text, transaction_id
from ..session import small, stash
from .sequence import chain_code, day_positions, occurrences

#: What tells transactions of a day apart, but for their number.
KEY = ("account_id", "transaction_date", "amount", "description")
#: A run of an account, by its number in order of export.
RUN = ("account_id", "run")
MERGED = "account_id string, family string, import_run_id string, payload_id string, status string, code string, transaction_id string, transaction_date date, amount decimal(19,2), description string, occurrence int, day_sequence int, balance decimal(19,2), record_ordinal int, review_item_id string"
#: Decisions that the merge reads, in force.
DECISIONS = "kind string, import_run_id string, transaction_id string, payload_id string, record_ordinal int"
#: A decision that a record shows a known transaction: the record, and what it shows.
SHOWS = "account_id string, run int, record_ordinal int, transaction_id string, transaction_date date, amount decimal(19,2), description string, n int, own_date date, own_amount decimal(19,2), own_description string"


def booked_rows(typed: DataFrame, runs: DataFrame) -> DataFrame:
    """Readable booked records with their identity: occurrence, position in the day, and transaction id."""
    of = runs.select("payload_id", F.col("account_id").cast("string").alias("account_id")).distinct()
    rows = typed.where("readable and booking_status = 'booked'").withColumn("description", identity_text(F.col("description"))).join(of, "payload_id")
    rows = occurrences(rows, "payload_id", "account_id", "transaction_date", "amount", "description", order="record_ordinal")
    rows = day_positions(rows, "payload_id", "transaction_date", "record_ordinal")
    return rows.withColumn("transaction_id", _identify(F.col("occurrence")))


def _identify(n: Column) -> Column:
    return transaction_id(F.col("account_id"), F.col("transaction_date"), F.col("amount"), F.col("description"), n)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _read(runs: DataFrame, typed: DataFrame) -> DataFrame:
    """Records under their run, with what they say beside the one before: all that is read of an export, which is dealt out once."""
    is_booked = F.col("booking_status") == "booked"
    link, booked = F.coalesce(~F.col("readable") | is_booked, F.lit(False)), F.coalesce(F.col("readable") & is_booked, F.lit(False))
    rows = typed.withColumn("__link", link)
    breaks = F.col("__link") & chain_code("payload_id", "__link", order="record_ordinal").isNotNull()
    rows = rows.select("payload_id", "record_ordinal", "transaction_date", "amount", identity_text(F.col("description")).alias("description"), "balance", booked.alias("booked"), breaks.alias("breaks"), F.size("errors").alias("n_errors"), "labelled")
    return rows.join(runs.select(*RUN, "payload_id"), "payload_id").drop("payload_id")


def _judged_alone(runs: DataFrame, read: DataFrame, accepted: DataFrame) -> DataFrame:
    """``runs`` with what their records alone say: errors, breaks, labels, and the dates between which they lie."""
    day = F.col("transaction_date")
    of = read.groupBy(*RUN).agg(
        F.sum("n_errors").alias("n_other"),
        F.bool_or("labelled").alias("labelled"),
        ((F.count("labelled") == F.count("*")) & F.bool_and("labelled").eqNullSafe(F.bool_or("labelled"))).alias("same_labels"),
        F.count(F.when(F.col("breaks"), 1)).alias("n_breaks"),
        F.min(F.when(F.col("breaks"), day)).alias("first_break"),
        F.min(F.when(F.col("booked"), day)).alias("least"),
        F.max(F.when(F.col("booked"), day)).alias("most"),
    )
    accepted = accepted.select("import_run_id").distinct().withColumn("accepted", F.lit(True))
    runs = runs.join(of, [*RUN], "left").join(accepted, "import_run_id", "left")
    n_other, n_breaks, accepted = F.coalesce("n_other", F.lit(0)), F.coalesce("n_breaks", F.lit(0)), F.coalesce("accepted", F.lit(False))
    return runs.select(*RUN, "import_run_id", "payload_id", "covers_from", "covers_through", "labelled", "first_break", "least", "most", "same_labels", accepted.alias("accepted"), ((n_other == 0) & ((n_breaks == 0) | accepted)).alias("valid"))


@dataclass
class _History:
    """What the rounds read of the accounts in doubt; ``taken`` and ``shows`` are what a round assumes."""

    #: Valid runs: ``RUN, import_run_id, payload_id, covers_from, covers_through, labelled``.
    runs: DataFrame
    #: How often a run shows each identity that isn't in ``alike``: ``KEY, run, c``.
    shown: DataFrame
    #: What the identities that all runs of a date show alike come to: ``account_id, transaction_date, total``.
    alike: DataFrame
    #: Runs that cover or show each date of their account's records: ``rank`` among them, how many there are, the balance at the day's end, and what is seen (``_seen``) if all are taken.
    days: DataFrame
    #: Decisions, or None if there are none: ``SHOWS``, and ``transaction_id`` of those withdrawn.
    named: DataFrame | None
    withdrawn: DataFrame | None

    def of(self, accounts: DataFrame) -> _History:
        keep = lambda df: df.join(accounts, "account_id", "left_semi")
        return _History(keep(self.runs), keep(self.shown), keep(self.alike), keep(self.days), self.named, self.withdrawn)


def _dates(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """``_History.days``: of the dates that records have, each run that covers or shows one."""
    span = runs.groupBy("account_id").agg(F.min("least").alias("a"), F.max("most").alias("z"))
    reach = runs.join(span, "account_id").select(*RUN, "labelled", F.greatest("covers_from", "a").alias("a"), F.least("covers_through", "z").alias("z")).where("a <= z")
    covers = reach.select(*RUN, F.explode(F.sequence("a", "z")).alias("transaction_date"), F.lit(None).cast("int").alias("record_ordinal"), F.lit(None).cast("decimal(19,2)").alias("balance"), "labelled", F.lit(True).alias("covers"))
    both = covers.unionByName(rows.select(*RUN, "transaction_date", "record_ordinal", "balance", "labelled", F.lit(False).alias("covers")))
    ends = F.max_by("balance", "record_ordinal").alias("ends")
    days = both.groupBy(*RUN, "transaction_date").agg(F.bool_or("covers").alias("covers"), (F.count("record_ordinal") > 0).alias("shows"), ends, F.bool_or("labelled").alias("labelled"))
    w = Window.partitionBy("account_id", "transaction_date").orderBy("run")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = _seen(days.withColumns({"taken": F.lit(True), "rank": F.row_number().over(w), "n_runs": F.count("*").over(whole), "__known": F.bool_or("shows").over(whole)}))
    return days.where("__known").drop("__known")


def _seen(days: DataFrame) -> DataFrame:
    """What a run finds of a date if those ``taken`` are admitted: ``first`` if none comes before it, and in ``theirs`` what the last one to speak says."""
    w = Window.partitionBy("account_id", "transaction_date").orderBy("run")
    earlier, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    first = ~F.coalesce(F.bool_or("taken").over(earlier), F.lit(False))
    days = days.withColumns({"first": first, "__shown": F.bool_or(F.col("taken") & F.col("shows")).over(so_far)})
    days = days.withColumn("__as", F.when(F.col("taken") & F.col("__shown"), F.struct("ends", "shows", "labelled")))
    return days.withColumn("theirs", F.last("__as", ignorenulls=True).over(earlier)).drop("__as", "__shown")


def _identities(rows: DataFrame, days: DataFrame, named: DataFrame | None) -> DataFrame:
    """``_History.shown`` and, without amount and run, ``_History.alike``; accounts in which decisions name a record have nothing alike."""
    day = ["account_id", "transaction_date"]
    shown = rows.repartition(*day).groupBy(*KEY, "run").agg(F.count("*").alias("c"))
    # Rows are sorted by a number in place of amount and text, which are compared only where it is the same.
    w = Window.partitionBy(*day, F.xxhash64("amount", "description"), *KEY[2:])
    shown = shown.withColumns({"__n": F.count("*").over(w), "__least": F.min("c").over(w), "__most": F.max("c").over(w), "__first": F.min("run").over(w)})
    shown = shown.join(days.where("rank = 1").select(*day, "n_runs"), day)
    alike = (F.col("__n") == F.col("n_runs")) & (F.col("__least") == F.col("__most"))
    if named is not None:
        shown = shown.join(named.select("account_id").distinct().withColumn("__named", F.lit(True)), "account_id", "left")
        alike &= F.col("__named").isNull()
    shown = shown.withColumn("alike", alike).where("not alike or run = __first")
    own = [F.when(~F.col("alike"), F.col(c)).alias(c) for c in (*KEY[2:], "run")]
    shown = shown.select(*day, "alike", *own, "c", F.when(F.col("alike"), F.col("amount") * F.col("c")).alias("__of"))
    return shown.groupBy(*day, "alike", *KEY[2:], "run").agg(F.max("c").alias("c"), F.sum("__of").cast("decimal(38,2)").alias("total"))


def _counts(h: _History, shows: DataFrame | None) -> DataFrame:
    """``KEY, run, c, as_taken``: an identity's count as a run has it, and with records under the identities that they are decided to show."""
    shown = h.shown.withColumn("as_taken", F.col("c"))
    if shows is not None:
        own = [F.col(f"own_{c}").alias(k) for c, k in (("date", "transaction_date"), ("amount", "amount"), ("description", "description"))]
        moves = shows.select(*KEY, "run", F.lit(0).cast("long").alias("c"), F.lit(1).cast("long").alias("as_taken"))
        moves = moves.unionByName(shows.select("account_id", *own, "run", F.lit(0).cast("long").alias("c"), F.lit(-1).cast("long").alias("as_taken")))
        shown = shown.unionByName(moves.join(h.runs.select(*RUN), [*RUN], "left_semi")).groupBy(*KEY, "run").agg(F.sum("c").alias("c"), F.sum("as_taken").alias("as_taken"))
    return shown


def _missing(h: _History, counts: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions admitted before a run that covers their date and lacks them, and what each run adds by date.

    The first has a row for each, with how it is settled; runs that don't show an
    identity at all are found as gaps between the ranks of those that do.
    """
    w = Window.partitionBy(*KEY).orderBy("rank")
    rows = counts.join(days.select(*RUN, "transaction_date", "taken", "covers", "rank", "n_runs"), [*RUN, "transaction_date"])
    taken = F.when(F.col("taken"), F.col("as_taken"))
    rows = rows.withColumns(
        {
            "before": F.coalesce(F.max(taken).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "after": F.coalesce(F.max(taken).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
            "next": F.coalesce(F.lead("rank").over(w), F.col("n_runs") + 1),
        }
    )
    # What all three kinds are read from is joined and sorted once.
    rows = rows.where("c > before or (covers and c < before) or (after > 0 and next > rank + 1)")
    rows = stash(rows.select(*KEY, "run", "taken", "covers", "c", "before", "after", "rank", F.col("next").cast("int").alias("next")), "compared")
    added = rows.where("c > before").groupBy(*RUN, "transaction_date").agg(F.sum(F.col("amount") * (F.col("c") - F.col("before"))).cast("decimal(38,2)").alias("change"))
    fewer = rows.where("covers and c < before").select(*KEY, "run", "taken", F.explode(F.sequence(F.col("c") + 1, F.col("before"))).alias("n"))
    gaps = rows.where("after > 0 and next > rank + 1").select(*KEY, "after", F.explode(F.sequence(F.col("rank") + 1, F.col("next") - 1)).alias("rank"))
    gaps = gaps.join(days.where("covers").select("account_id", "transaction_date", "rank", "run", "taken"), ["account_id", "transaction_date", "rank"])
    gaps = gaps.select(*KEY, "run", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.col("after"))).alias("n"))
    missing = fewer.unionByName(gaps).withColumn("n", F.col("n").cast("int")).withColumn("transaction_id", _identify(F.col("n")))
    if h.named is None:
        missing = missing.withColumn("ordinal", F.lit(None).cast("int"))
    else:
        same = h.named.groupBy(*RUN, "transaction_id").agg(F.min("record_ordinal").alias("ordinal"))
        missing = missing.join(same, [*RUN, "transaction_id"], "left")
    if h.withdrawn is None:
        return missing.withColumn("withdrawn", F.lit(False)), added
    gone = h.withdrawn.withColumn("__gone", F.lit(True))
    missing = missing.join(gone, "transaction_id", "left").withColumn("withdrawn", F.col("ordinal").isNull() & F.col("__gone").isNotNull()).drop("__gone")
    # What an admitted run's lack has withdrawn is no longer there for later runs to lack.
    earlier = Window.partitionBy(*KEY, "n").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    missing = missing.withColumn("__gone", F.bool_or(F.col("withdrawn") & F.col("taken")).over(earlier))
    return missing.where("not coalesce(__gone, false)").drop("__gone"), added


def _verdicts(h: _History, days: DataFrame, assumed: DataFrame, shows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Under what is assumed, and seen in ``days``, each run with its verdict, and what is missing (stashed)."""
    missing, added = _missing(h, _counts(h, shows), days)
    missing = stash(missing, "missing")
    none = lambda kind: F.lit(None).cast(kind)
    money = "decimal(38,2)"
    lost = F.col("covers") & ~F.col("labelled") & F.col("theirs.labelled") & F.col("theirs.shows")
    states = days.select(*RUN, "transaction_date", F.lit(0).cast(money).alias("change"), "ends", F.when(F.col("shows"), F.col("theirs.ends")).alias("before"), lost.alias("lost"))
    moved = added.unionByName(missing.groupBy(*RUN, "transaction_date").agg((-F.sum("amount")).cast(money).alias("change")))
    moved = moved.unionByName(days.where("first").join(h.alike, ["account_id", "transaction_date"]).select(*RUN, "transaction_date", F.col("total").alias("change")))
    sums = states.unionByName(moved.select("*", none("decimal(19,2)").alias("ends"), none("decimal(19,2)").alias("before"), none("boolean").alias("lost")))
    # Dealt out by run, once for its dates' sums, what they run to, and its verdict.
    sums = sums.repartition(*RUN).groupBy(*RUN, "transaction_date").agg(F.sum("change").alias("change"), F.max("ends").alias("ends"), F.max("before").alias("before"), F.bool_or("lost").alias("lost"))
    change = F.sum("change").over(Window.partitionBy(*RUN).orderBy("transaction_date").rowsBetween(Window.unboundedPreceding, 0))
    apart = F.min(F.when(F.col("ends") - F.col("before") != F.col("change"), F.col("transaction_date")))
    found = sums.withColumn("change", change).groupBy(*RUN).agg(apart.alias("apart"), F.bool_or("lost").alias("lost"))
    open_ = missing.where("ordinal is null and not withdrawn").select(*RUN).distinct().withColumn("open", F.lit(True))
    runs = assumed.join(found, [*RUN], "left").join(open_, [*RUN], "left")
    code = F.when(F.col("lost"), "label-layout-regressed").when(F.col("apart").isNotNull() | F.col("open"), "review")
    return runs.select(*RUN, "taken", "apart", code.alias("code")), missing


def _effective(missing: DataFrame, named: DataFrame | None) -> DataFrame | None:
    """Of the named decisions, those whose transaction the run lacks; a record that would show several shows the last in order."""
    if named is None:
        return None
    lacks = missing.where("ordinal is not null").select(*RUN, "transaction_id", F.col("ordinal").alias("record_ordinal"))
    found = named.join(lacks, [*RUN, "transaction_id", "record_ordinal"], "left_semi")
    last = F.row_number().over(Window.partitionBy(*RUN, "record_ordinal").orderBy(F.desc("transaction_date"), F.desc("amount"), F.desc("description"), F.desc("n")))
    return found.withColumn("__k", last).where("__k = 1").drop("__k")


def _settled(h: _History) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Each valid run's verdict (``RUN, apart, code``), what it lacks, and the decisions that take effect."""
    assumed, shows, days = h.runs.select(*RUN, F.lit(True).alias("taken")), h.named, h.days
    done: list[tuple[DataFrame, DataFrame, DataFrame | None]] = []
    while True:
        verdicts, missing = _verdicts(h, days, assumed, shows)
        verdicts = stash(verdicts, "verdicts")
        effective = _effective(missing, h.named)
        doubt = verdicts.where(F.col("taken") != F.col("code").isNull()).select("account_id")
        if effective is not None:
            effective = stash(effective, "shows")
            own = ["account_id", "run", "record_ordinal", "transaction_id"]
            before = shows.select(*own).join(h.runs.select(*RUN), [*RUN], "left_semi")
            doubt = doubt.unionByName(before.exceptAll(effective.select(*own)).unionByName(effective.select(*own).exceptAll(before)).select("account_id"))
        doubt = stash(doubt.distinct(), "doubt")
        done.append((verdicts.join(doubt, "account_id", "left_anti"), missing.join(doubt, "account_id", "left_anti"), None if effective is None else effective.join(doubt, "account_id", "left_anti")))
        if doubt.isEmpty():
            break
        h, assumed, shows = h.of(doubt), verdicts.select(*RUN, F.col("code").isNull().alias("taken")).join(doubt, "account_id", "left_semi"), effective
        days = stash(_seen(h.days.drop("taken", "first", "theirs").join(assumed, [*RUN])), "seen")
    return _union([d[0] for d in done]), _union([d[1] for d in done]), None if h.named is None else _union([d[2] for d in done])


def _history(rows: DataFrame, admitted: DataFrame, days: DataFrame, gone: DataFrame, shows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Transactions that are kept, in the order of their days, and each record that shows one."""
    of = rows.join(admitted, [*RUN])
    # Records that a run shows under one identity are numbered; those left where one has gone elsewhere are so anew.
    order, number = (lambda *by: Window.partitionBy(F.xxhash64(*KEY, "run"), *KEY, "run", *by).orderBy("record_ordinal")), F.row_number()
    if shows is None:
        of = of.withColumn("occurrence", number.over(order()))
    else:
        target = [F.col(c).alias(f"to_{c}") for c in (*KEY[1:], "n")]
        of = of.join(shows.select(*RUN, "record_ordinal", *target), [*RUN, "record_ordinal"], "left")
        moved = F.col("to_n").isNotNull()
        of = of.withColumn("occurrence", F.when(moved, F.col("to_n")).otherwise(number.over(order(moved))))
        of = of.withColumns({c: F.coalesce(f"to_{c}", c) for c in KEY[1:]})
    kept = of.join(gone, [*KEY, "occurrence"], "left_anti")
    known = F.min(F.when(F.col("shows"), F.col("run")))
    speaks = days.join(admitted.select(*RUN), [*RUN], "left_semi").groupBy("account_id", "transaction_date").agg(F.max("run").alias("speaks"), known.alias("known")).where("known is not null").drop("known")
    kept = kept.select(*KEY, "occurrence", "run", "import_run_id", "payload_id", "record_ordinal", "balance")
    # Dealt out once by account and day; ids, which say no more than the identity, are made last.
    latest = kept.repartition("account_id", "transaction_date").groupBy(*KEY, "occurrence").agg(F.max(F.struct("run", "record_ordinal", "import_run_id", "payload_id", "balance")).alias("r"))
    listed = latest.join(speaks, ["account_id", "transaction_date"], "left")
    # The run that speaks for a date is the last that can show it: a transaction that it shows has no later record.
    own, name = F.coalesce(F.col("r.run") == F.col("speaks"), F.lit(False)), _identify(F.col("occurrence"))
    at = F.row_number().over(Window.partitionBy("account_id", "transaction_date").orderBy(F.desc("own"), F.when(F.col("own"), F.col("r.record_ordinal")), F.when(~F.col("own"), name)))
    listed = listed.withColumn("own", own).withColumn("day_sequence", at)
    return listed.select(*KEY, "occurrence", name.alias("transaction_id"), "day_sequence", "r.import_run_id", "r.payload_id", "r.record_ordinal", "r.balance"), kept.withColumn("transaction_id", name)


def merge(runs: DataFrame, typed: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Judge stored runs and merge what is admitted: one tagged row for each result, review, transaction and evidence.

    ``runs``: ``import_run_id, payload_id, account_id, exported_on, started_at,
    covers_from, covers_through``. ``decisions`` (``DECISIONS``): ``void-import-run``
    leaves a run out, ``accept-discrepancy`` admits one with balance breaks,
    ``withdrawn`` and ``same-transaction`` settle transactions that a later export
    lacks. Runs are taken by day of export, start and id. A run without records is
    admitted and may lack what earlier ones show.
    """
    spark = runs.sparkSession
    if decisions is None:
        decisions = spark.range(1).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in DECISIONS.split(", ")]).limit(0)
    of = lambda kind: decisions.where(F.col("kind") == kind)
    runs = runs.withColumn("account_id", F.col("account_id").cast("string")).join(of("void-import-run").select("import_run_id"), "import_run_id", "left_anti")
    order = Window.partitionBy("account_id").orderBy("exported_on", "started_at", "import_run_id")
    runs = stash(runs.select("import_run_id", "payload_id", "account_id", "covers_from", "covers_through", F.row_number().over(order).alias("run")), "numbered")
    read = stash(_read(runs, typed), "read")
    runs = stash(_judged_alone(runs, read, of("accept-discrepancy")), "runs")
    valid, refused = runs.where("valid"), runs.where("not valid").select(*RUN)
    rows, n_refused = read.where("booked").select(*KEY, "run", "record_ordinal", "balance", "labelled"), refused.count()
    if n_refused:
        rows = rows.join(small(refused, n_refused), [*RUN], "left_anti")
    unlike = valid.where("not same_labels").select(*RUN, F.col("labelled").alias("__labelled"), F.lit(True).alias("__unlike"))
    n_unlike = unlike.count()
    if n_unlike:
        rows = rows.join(small(unlike, n_unlike), [*RUN], "left").withColumn("labelled", F.when(F.col("__unlike"), F.col("__labelled")).otherwise(F.col("labelled"))).drop("__labelled", "__unlike")
    days = stash(_dates(valid, rows), "days")
    named = _named(of("same-transaction"), rows, valid)
    withdrawn = of("withdrawn").select("transaction_id").distinct()
    withdrawn = None if withdrawn.isEmpty() else withdrawn
    found = stash(_identities(rows, days, named), "identities")
    alike, shown = found.where("alike").select("account_id", "transaction_date", "total"), stash(found.where("not alike").select(*KEY, "run", "c"), "shown")
    verdicts, missing, shows = _settled(_History(valid, shown, alike, days, named, withdrawn))
    admitted = stash(verdicts.where("code is null").select(*RUN).join(valid.select(*RUN, "import_run_id", "payload_id"), [*RUN]), "admitted")
    gone = missing.where("withdrawn").join(admitted.select(*RUN), [*RUN], "left_semi").select(*KEY, F.col("n").alias("occurrence"))
    listed, kept = _history(rows, admitted, days, gone, shows)
    names = {c.split()[0]: c.split()[1] for c in MERGED.split(", ")}
    filled = lambda df, family: df.select(*[F.lit(family).alias(c) if c == "family" else F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()])
    judged = runs.join(verdicts, [*RUN], "left")
    code = F.when(~F.col("valid"), "errors").otherwise(F.col("code"))
    results = judged.withColumn("code", code).withColumn("status", F.when(F.col("code").isNull(), "accepted").otherwise("quarantined"))
    asked = judged.where("valid and coalesce(code, '') <> 'label-layout-regressed'").select(*RUN, "import_run_id", "payload_id", "apart")
    settled = F.when(F.col("ordinal").isNull() & ~F.col("withdrawn"), "open").otherwise("resolved")
    dropped = missing.join(asked, [*RUN]).withColumns({"code": F.lit("dropped-transaction"), "occurrence": F.col("n"), "status": settled, "review_item_id": hash_parts(F.lit("dropped-transaction"), F.col("import_run_id"), F.col("transaction_id"))})
    apart = asked.where("apart is not null").withColumns({"code": F.lit("export-disagreement"), "transaction_date": F.col("apart"), "status": F.lit("open"), "review_item_id": hash_parts(F.lit("export-disagreement"), F.col("import_run_id"))})
    breaks = runs.where("first_break is not null").withColumns({"code": F.lit("balance-break"), "transaction_date": F.col("first_break"), "status": F.when(F.col("accepted"), "resolved").otherwise("open"), "review_item_id": hash_parts(F.lit("balance-break"), F.col("import_run_id"))})
    return _union([filled(results, "result"), *[filled(x, "review") for x in (dropped, apart, breaks)], filled(listed, "transaction"), filled(kept, "evidence")])


def _named(decisions: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame | None:
    """``SHOWS``: decisions that name a record of a valid run and a transaction that some record of its account shows; None without any."""
    if decisions.isEmpty():
        return None
    wanted = decisions.select("transaction_id", "payload_id", "record_ordinal").distinct().join(runs.select(*RUN, "payload_id"), "payload_id").drop("payload_id")
    own = [F.col("transaction_date").alias("own_date"), F.col("amount").alias("own_amount"), F.col("description").alias("own_description")]
    record = wanted.join(rows.select(*RUN, "record_ordinal", *own), [*RUN, "record_ordinal"])
    near = rows.join(wanted.select("account_id").distinct(), "account_id", "left_semi")
    near = occurrences(near, "run", *KEY, order="record_ordinal")
    known = near.withColumn("transaction_id", _identify(F.col("occurrence"))).join(wanted.select("account_id", "transaction_id").distinct(), ["account_id", "transaction_id"], "left_semi").select(*KEY, F.col("occurrence").alias("n"), "transaction_id").distinct()
    return stash(record.join(known, ["account_id", "transaction_id"]).select(*[c.split()[0] for c in SHOWS.split(", ")]), "named")
