"""Ledgers: running balances in exact cents, totals, as-of balances, and checks of entries against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import comparable
from tidemark.operators.frames import Frame, frames
from tidemark.operators.running import running

MONEY = "decimal(38,2)"


def signed(amount: Column, is_debit: Column) -> Column:
    exact = amount.cast(MONEY)
    return F.when(is_debit, -exact).otherwise(exact)


def running_balance(entries: DataFrame, account: str, order: list[str], movement: Column, opening: Column | None = None, out: str = "balance_after") -> DataFrame:
    """entries with the account's balance after each, in a total order whose first column is a number or time."""
    start = F.lit(0).cast(MONEY) if opening is None else opening.cast(MONEY)
    first = comparable(entries, order[0])
    run = running(entries.withColumns({"_first": first, "_moved": movement.cast(MONEY)}), [account], ["_first", *order[1:]], {"_sum": ("sum", "_moved")})
    return run.withColumn(out, (start + F.col("_sum")).cast(MONEY)).drop("_first", "_moved", "_sum")


def balance_as_of(entries: DataFrame, asked: DataFrame, account: str, *, id_: str) -> DataFrame:
    """(id_, moved) for each row of asked(account, id_, now): the sum of the movements effective before `now` and posted at or before it.

    entries: account, effective_at, posted_at (microseconds) and movement.
    """
    known = entries.select(account, F.col("effective_at").alias("t"), F.col("posted_at").alias("available"), "movement")
    return frames(known, asked, [account], {"moved": Frame("sum", None, "movement")}, id_=id_)


def totals_by(entries: DataFrame, key: Column, amount: str, is_debit: Column) -> DataFrame:
    """(shard, debits, credits, entries, balanced) for each value of the key."""
    exact = F.col(amount).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    out = entries.groupBy(key.alias("shard")).agg(F.sum(F.when(is_debit, exact).otherwise(zero)).cast(MONEY).alias("debits"), F.sum(F.when(is_debit, zero).otherwise(exact)).cast(MONEY).alias("credits"), F.count("*").alias("entries"))
    return out.withColumn("balanced", F.col("debits") == F.col("credits"))


def balance_breaks(entries: DataFrame, account: str, order: list[str], movement: str, after: str) -> DataFrame:
    """Entries whose balance is not the balance before plus the movement."""
    before = F.lag(after).over(Window.partitionBy(account).orderBy(*order))
    return entries.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col(after) != F.col("_before") + F.col(movement))).drop("_before")


def validate_entries(entries: DataFrame, *, payment: str = "payment_id", side: str = "entry_type", amount: str = "amount") -> DataFrame:
    """violations(rule, key, detail): two sides for each payment, equal amounts, one debit and one credit."""
    per = entries.groupBy(payment).agg(F.count("*").alias("n"), F.sum((F.col(side) == "DEBIT").cast("int")).alias("d"), F.min(F.col(amount).cast(MONEY)).alias("lo"), F.max(F.col(amount).cast(MONEY)).alias("hi"))
    rules = {"two_sides": F.col("n") != 2, "one_debit": F.col("d") != 1, "equal_amounts": F.col("lo") != F.col("hi")}
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules.items()]))
    return per.select(F.explode(found).alias("rule"), F.col(payment).cast("string").alias("key"), F.concat_ws(",", "n", "d", "lo", "hi").alias("detail"))


#: States in which a payment without ledger entries counts as paid.
PAID = ("SETTLED", "COMPLETED", "RECEIVED")


def realized_loss(payments: DataFrame, entries: DataFrame) -> DataFrame:
    """(payment_id, loss) of each payment: its payer's debits less credits, not below 0.

    A payment without entries has lost its amount where its current_status is one of PAID, else nothing. Entries are summed
    by payment and account before they meet the payments, so a payment with many entries is one row by then. Null amounts
    count as none; entries of unknown payments are left out; repeated payments give repeated rows.
    """
    debit = F.col("entry_type") == "DEBIT"
    net = entries.groupBy("payment_id", "account_id").agg(F.sum(-signed(F.col("amount"), debit)).alias("_net"))
    per = net.groupBy("payment_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("account_id", F.lit("")), F.coalesce("_net", F.lit(0).cast(MONEY))))).alias("_by"))
    status = F.when(F.col("current_status").isin(*PAID), F.col("amount").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    moved = F.greatest(F.lit(0).cast(MONEY), F.coalesce(F.try_element_at("_by", F.coalesce("payer_account_id", F.lit(""))), F.lit(0).cast(MONEY)))
    return payments.join(per, "payment_id", "left").select("payment_id", F.when(F.col("_by").isNull(), F.coalesce(status, F.lit(0).cast(MONEY))).otherwise(moved).alias("loss"))
