"""Accounts and transactions: sums, trends, running balances. Money is DECIMAL(18,2) until it is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.operators.intervals import within


def _shown(c: str):
    return F.col(c).cast("double").alias(c)


def health(accounts: DataFrame) -> DataFrame:
    """Checking, savings, debt (negated credit cards) and net worth."""
    of = lambda kind: F.sum(F.when(F.col("account_type") == kind, F.col("balance")).otherwise(F.lit(0).cast("decimal(18,2)")))
    sums = accounts.agg(of("checking").alias("checking"), of("savings").alias("savings"), (-of("credit_card")).alias("debt"))
    return sums.withColumn("net", F.col("checking") + F.col("savings") - F.col("debt")).select(*map(_shown, ("checking", "savings", "debt", "net")))


def by_category(transactions: DataFrame, month: str) -> DataFrame:
    """Spending of a month (its first day) by category, largest first."""
    own = transactions.where((F.col("date") >= F.lit(month).cast("date")) & (F.col("date") < F.add_months(F.lit(month).cast("date"), 1)))
    return own.groupBy("category").agg(F.sum("amount").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "category").select("category", _shown("total"), "n")


def top_categories(transactions: DataFrame, month: str, n: int = 5) -> DataFrame:
    return by_category(transactions, month).limit(n)


def month_over_month(transactions: DataFrame) -> DataFrame:
    """Each month's total and its change from the month before that has any."""
    months = transactions.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("amount").alias("total"))
    before = F.lag("total").over(Window.orderBy("month"))
    return months.select("month", F.col("total").cast("double").alias("total"), (F.col("total") - before).cast("double").alias("change"))


def trend(transactions: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Income (kind O) and expense (others) of the last months before ``as_of``."""
    first = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -months)
    own = transactions.where((F.col("date") >= first) & (F.col("date") < F.trunc(F.lit(as_of).cast("date"), "month")))
    zero = F.lit(0).cast("decimal(18,2)")
    sums = own.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum(F.when(F.col("kind") == "O", F.col("amount")).otherwise(zero)).alias("income"), F.sum(F.when(F.col("kind") != "O", F.col("amount")).otherwise(zero)).alias("expense"))
    return sums.select("month", _shown("income"), _shown("expense"))


def forecast(transactions: DataFrame) -> DataFrame:
    """Linear trend of monthly totals: slope a month and the line's start."""
    months = transactions.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("amount").cast("double").alias("total"))
    index = F.months_between("month", F.lit("1990-01-01").cast("date"))
    return months.withColumn("x", index).agg(F.round(F.regr_slope("total", "x"), 2).alias("slope"), F.round(F.regr_intercept("total", "x"), 2).alias("intercept"))


def running_balance(transactions: DataFrame) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    return transactions.select("account_id", "id", F.sum("amount").over(w).cast("double").alias("balance"))


def first_below(accounts: DataFrame, transactions: DataFrame, floor: float) -> DataFrame:
    """The first transaction that takes an account, from its balance times 100, below a floor."""
    w = Window.partitionBy("account_id").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    spent = transactions.select("account_id", "id", "date", F.sum("amount").over(w).alias("spent"))
    low = spent.join(accounts.select(F.col("id").alias("account_id"), "balance"), "account_id").where(F.col("balance") * 100 - F.col("spent") < F.lit(floor).cast("decimal(18,2)"))
    return low.groupBy("account_id").agg(F.min(F.struct("date", "id")).alias("first")).select("account_id", "first.date", "first.id")


def crossings(accounts: DataFrame, transactions: DataFrame, threshold: str) -> DataFrame:
    """Transactions (account_id, id, at, change) that take an account's balance from the threshold or more to less."""
    opening = accounts.select(F.col("id").alias("account_id"), F.col("balance").alias("opening"))
    w = Window.partitionBy("account_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    booked = transactions.join(opening, "account_id").withColumn("balance", (F.col("opening") + F.sum("change").over(w)).cast("decimal(18,2)"))
    least = F.lit(threshold).cast("decimal(18,2)")
    return booked.where((F.col("balance") < least) & (F.col("balance") - F.col("change") >= least)).select("account_id", "id", "at", "balance")


def large(transactions: DataFrame, least: float, since: str) -> DataFrame:
    return transactions.where((F.col("amount") > F.lit(least).cast("decimal(18,2)")) & (F.col("date") > F.lit(since).cast("date"))).select("id", _shown("amount"), "date")


def trip_budgets(destinations: DataFrame, activities: DataFrame) -> DataFrame:
    """Budget, cost and what is left of each trip."""
    cost = activities.groupBy("destination_id").agg(F.sum("cost").alias("cost"))
    zero = F.lit(0).cast("decimal(18,2)")
    joined = destinations.join(cost, destinations["id"] == cost["destination_id"], "left").withColumn("cost", F.coalesce("cost", zero))
    return joined.select("id", "name", _shown("budget"), _shown("cost"), (F.col("budget") - F.col("cost")).cast("double").alias("left"))


def during(transactions: DataFrame, trips: DataFrame) -> DataFrame:
    """Transactions within trips (trip_id, arrival, departure), by blocks of days."""
    days = trips.select("trip_id", F.unix_date("arrival").alias("low"), F.unix_date("departure").alias("high"))
    return within(transactions.withColumn("__day", F.unix_date("date")), "__day", days, "low", "high").groupBy("trip_id").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
