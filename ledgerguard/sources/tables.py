"""Inputs: the driver's parquet tables and the eight contract tables derived from them.

The contract tables (Contracts, Customers, LeaseFinances, LoanFinances, PayableInvoices, LeaseFundings,
Receivables, ReceivableDetails) are expressed as lazy DataFrames over the TPC-H-like driver tables, so
every query plan reads the given parquet and scales with it. Column pruning and filters reach the
parquet scans through Catalyst. ``load_tables`` reads already-materialised contract tables with their
declared schemas instead.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerguard.session import by_key

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CONTRACT_TABLES = ("contracts", "customers", "leasefinances", "loanfinances", "payableinvoices",
                   "leasefundings", "receivables", "receivabledetails")

# Default as-of date for the driver data (its dates run 1992-2001).
AS_OF = date(1998, 10, 1)

MONEY = T.DecimalType(18, 2)

# Declared schemas of the contract tables (ids are LongType because the driver keys are 64-bit).
SCHEMAS: dict[str, T.StructType] = {
    "contracts": T.StructType([
        T.StructField("Id", T.LongType(), False), T.StructField("SequenceNumber", T.StringType(), False),
        T.StructField("Status", T.StringType(), True), T.StructField("WorkflowStatus", T.StringType(), False),
        T.StructField("CommencementDate", T.DateType(), True), T.StructField("ContractType", T.StringType(), False)]),
    "customers": T.StructType([
        T.StructField("Id", T.LongType(), False), T.StructField("FirstName", T.StringType(), False),
        T.StructField("LastName", T.StringType(), True), T.StructField("CustomerType", T.StringType(), False),
        T.StructField("AddressLine1", T.StringType(), True), T.StructField("AddressLine2", T.StringType(), True),
        T.StructField("Zip", T.StringType(), True), T.StructField("SSN", T.StringType(), True),
        T.StructField("Phone", T.StringType(), True), T.StructField("Email", T.StringType(), True)]),
    "leasefinances": T.StructType([
        T.StructField("Id", T.LongType(), False), T.StructField("ContractId", T.LongType(), False),
        T.StructField("Status", T.StringType(), False), T.StructField("BookingDate", T.DateType(), True),
        T.StructField("DownPayment", MONEY, False), T.StructField("CustomerId", T.LongType(), False)]),
    "loanfinances": T.StructType([
        T.StructField("Id", T.LongType(), False), T.StructField("ContractId", T.LongType(), False),
        T.StructField("Status", T.StringType(), False), T.StructField("BookingDate", T.DateType(), True),
        T.StructField("CustomerId", T.LongType(), False)]),
    "payableinvoices": T.StructType([
        T.StructField("Id", T.LongType(), False), T.StructField("InvoiceAmount", MONEY, False),
        T.StructField("Status", T.StringType(), False), T.StructField("InvoiceDate", T.DateType(), False),
        T.StructField("InvoiceTaxAmount", MONEY, False), T.StructField("Currency", T.StringType(), False)]),
    "leasefundings": T.StructType([
        T.StructField("LeaseFinanceId", T.LongType(), False), T.StructField("PayableInvoiceId", T.LongType(), False)]),
    "receivables": T.StructType([
        T.StructField("Id", T.LongType(), False), T.StructField("EntityId", T.LongType(), False),
        T.StructField("EntityType", T.StringType(), False), T.StructField("Amount", MONEY, False),
        T.StructField("TaxAmount", MONEY, False), T.StructField("DueDate", T.DateType(), False),
        T.StructField("IsActive", T.BooleanType(), False)]),
    "receivabledetails": T.StructType([
        T.StructField("ReceivableId", T.LongType(), False), T.StructField("IsTaxAssessed", T.BooleanType(), False),
        T.StructField("BillingStatus", T.StringType(), False), T.StructField("DueDate", T.DateType(), False),
        T.StructField("Amount", MONEY, False), T.StructField("TaxAmount", MONEY, False),
        T.StructField("Balance", MONEY, False)]),
}


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(c) -> F.Column:
    return c.cast(MONEY)


def _str(c) -> F.Column:
    return c.cast("string")


def _lpad_mod(c, mod: int, width: int) -> F.Column:
    return F.lpad(_str(c % mod), width, "0")


def derive_contracts(orders: DataFrame) -> DataFrame:
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("Id"),
        F.concat(F.lit("CT-"), _str(F.col("o_orderkey"))).alias("SequenceNumber"),
        F.when(prio == "4-NOT SPECIFIED", F.lit(None).cast("string"))
         .when(status == "F", "PaidOff").when(status == "P", "Restructure")
         .when(prio == "5-LOW", "Rebook").otherwise("Commenced").alias("Status"),
        F.when(prio == "1-URGENT", "Commenced").when(prio == "2-HIGH", "Approved")
         .when(prio == "3-MEDIUM", "Submitted").when(prio == "4-NOT SPECIFIED", "Documents Submitted")
         .otherwise("Documents Revision").alias("WorkflowStatus"),
        F.when(prio == "4-NOT SPECIFIED", F.lit(None).cast("date"))
         .otherwise(F.col("o_orderdate").cast("date")).alias("CommencementDate"),
        F.when(F.col("o_orderkey") % 3 == 0, "Loan").otherwise("Lease").alias("ContractType"))


def derive_customers(customer: DataFrame) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return customer.select(
        key.alias("Id"),
        F.concat(F.lit("Fn"), _str(key)).alias("FirstName"),
        F.when(nation % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Ln"), _str(nation))).alias("LastName"),
        F.when(nation % 2 == 0, "Individual").otherwise("Business").alias("CustomerType"),
        F.concat(_str(key), F.lit(" Market Street")).alias("AddressLine1"),
        F.when(key % 3 == 0, F.concat(F.lit("Unit "), _str(nation))).alias("AddressLine2"),
        _lpad_mod(key, 100000, 5).alias("Zip"),
        F.concat(F.lit("900-"), F.lpad(_str(nation), 2, "0"), F.lit("-"), _lpad_mod(key, 10000, 4)).alias("SSN"),
        F.concat(F.lit("555-"), _lpad_mod(key, 10000, 4)).alias("Phone"),
        F.concat(F.lit("fn"), _str(key), F.lit("@example.com")).alias("Email"))


def derive_leasefinances(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("o_orderkey") % 3 != 0).select(
        F.col("o_orderkey").alias("Id"), F.col("o_orderkey").alias("ContractId"),
        F.lit("Commenced").alias("Status"), F.col("o_orderdate").cast("date").alias("BookingDate"),
        _money(F.col("o_totalprice")).alias("DownPayment"), F.col("o_custkey").alias("CustomerId"))


def derive_loanfinances(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("o_orderkey") % 3 == 0).select(
        F.col("o_orderkey").alias("Id"), F.col("o_orderkey").alias("ContractId"),
        F.lit("Commenced").alias("Status"), F.col("o_orderdate").cast("date").alias("BookingDate"),
        F.col("o_custkey").alias("CustomerId"))


def derive_payableinvoices(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("Id"), _money(F.col("p_retailprice")).alias("InvoiceAmount"),
        F.lit("Paid").alias("Status"), F.lit(date(1998, 1, 1)).alias("InvoiceDate"),
        _money(F.col("p_size")).alias("InvoiceTaxAmount"),
        F.when(F.col("p_partkey") % 4 == 0, "EUR").otherwise("USD").alias("Currency"))


def derive_leasefundings(lineitem: DataFrame) -> DataFrame:
    pairs = (lineitem.where(F.col("l_orderkey") % 3 != 0)
             .select(F.col("l_orderkey").alias("LeaseFinanceId"), F.col("l_partkey").alias("PayableInvoiceId")))
    return by_key(pairs, "LeaseFinanceId", "PayableInvoiceId").distinct()


def _receivable_id() -> F.Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def derive_receivabledetails(lineitem: DataFrame) -> DataFrame:
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    status = (F.when((rf == "A") & (ls == "F"), "Paid").when(rf == "A", "Suspended")
              .when((rf == "R") & (ls == "F"), "Suppressed").when(rf == "R", "NotInvoiced").otherwise("Invoiced"))
    amount, tax = _money(F.col("l_extendedprice")), _money(F.col("l_quantity"))
    x = lineitem.select(
        _receivable_id().alias("ReceivableId"), (F.col("l_partkey") % 5 == 0).alias("IsTaxAssessed"),
        status.alias("BillingStatus"), F.col("l_shipdate").cast("date").alias("DueDate"),
        amount.alias("Amount"), tax.alias("TaxAmount"), (F.col("l_discount") >= 0.05).alias("partial"))
    balance = (F.when(F.col("BillingStatus") == "Paid", F.lit(0))
               .when(F.col("partial"), F.col("Amount")).otherwise(F.col("Amount") + F.col("TaxAmount")))
    return x.select("ReceivableId", "IsTaxAssessed", "BillingStatus", "DueDate", "Amount", "TaxAmount",
                    _money(balance).alias("Balance"))


def derive_receivables(lineitem: DataFrame) -> DataFrame:
    # Grouped by the receivable id (a 1:1 function of (l_orderkey, l_linenumber) for line numbers 0-7): the
    # result is hash-partitioned on Id, so the join to the details needs no second exchange on this side,
    # and EntityId / EntityType / IsActive are expressions of the grouping key, so filters on them
    # (EntityType = 'CT' AND IsActive, EntityId = ...) are pushed below the aggregation by Catalyst.
    rid = _receivable_id()
    line, order = F.col("Id") % 8, F.floor(F.col("Id") / 8)
    lines = lineitem.select(rid.alias("Id"), "l_extendedprice", "l_quantity", "l_shipdate")
    return (by_key(lines, "Id").groupBy("Id")
            .agg(_money(F.sum(_money(F.col("l_extendedprice")))).alias("Amount"),
                 _money(F.sum(_money(F.col("l_quantity")))).alias("TaxAmount"),
                 F.min("l_shipdate").cast("date").alias("DueDate"))
            .select("Id", order.cast("long").alias("EntityId"),
                    F.when(line == 7, "SU").otherwise("CT").alias("EntityType"),
                    "Amount", "TaxAmount", "DueDate",
                    ((order + line) % 11 != 0).alias("IsActive")))


def derive_contract_notes(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """A PII-dense free-text column per contract (name, email, phone, SSN, card number)."""
    c = customers
    note = F.concat(
        F.lit("Reach "), F.upper(c.FirstName), F.lit(" "), F.coalesce(c.LastName, F.lit("Inc")), F.lit(" at "),
        c.Email, F.lit(" or "), c.Phone, F.lit(", ssn "), c.SSN, F.lit(", card 4111 1111 1111 111"),
        _str(F.col("o_orderkey") % 10), F.lit(" re CT-"), _str(F.col("o_orderkey")))
    return (orders.select("o_orderkey", "o_custkey")
            .join(c, F.col("o_custkey") == c.Id)
            .select(F.col("o_orderkey").alias("ContractId"), F.col("o_custkey").alias("CustomerId"), note.alias("note")))


class ContractTables(dict):
    """name -> DataFrame for the eight contract tables plus ``contract_notes``; lazily derived."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def driver(self, name: str) -> DataFrame:
        return read_driver(self.spark, self.sf_dir, name)

    def __missing__(self, name: str) -> DataFrame:
        d = self.driver
        builders = {
            "contracts": lambda: derive_contracts(d("orders")),
            "customers": lambda: derive_customers(d("customer")),
            "leasefinances": lambda: derive_leasefinances(d("orders")),
            "loanfinances": lambda: derive_loanfinances(d("orders")),
            "payableinvoices": lambda: derive_payableinvoices(d("part")),
            "leasefundings": lambda: derive_leasefundings(d("lineitem")),
            "receivables": lambda: derive_receivables(d("lineitem")),
            "receivabledetails": lambda: derive_receivabledetails(d("lineitem")),
            "contract_notes": lambda: derive_contract_notes(d("orders"), self["customers"]),
            "requests": lambda: derive_requests(d("customer")),
        }
        if name not in builders:
            df = d(name)
        else:
            df = builders[name]()
        self[name] = df
        return df


def contract_tables(spark: SparkSession, sf_dir: str) -> ContractTables:
    return ContractTables(spark, sf_dir)


def load_tables(spark: SparkSession, tables_dir: str, names=CONTRACT_TABLES) -> dict[str, DataFrame]:
    """Read materialised contract tables with their declared schemas (no inference)."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{tables_dir.rstrip('/')}/{n}") for n in names}


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_counts(tables: dict[str, DataFrame], names=CONTRACT_TABLES) -> DataFrame:
    """Row count per table, as one UNION ALL of global aggregates."""
    parts = [tables[n].agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(n).alias("TableName"), "Rows")
             for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_receivables(staged: DataFrame, details: DataFrame) -> DataFrame:
    """Parent receivable amounts are the SUM of their details, grouped by all parent columns."""
    d = details.select(F.col("ReceivableId"), F.col("Amount").alias("_a"), F.col("TaxAmount").alias("_t"))
    return (staged.join(d, staged.Id == d.ReceivableId)
            .groupBy("Id", "EntityId", "EntityType", "DueDate", "IsActive")
            .agg(_money(F.sum("_a")).alias("Amount"), _money(F.sum("_t")).alias("TaxAmount"))
            .select("Id", "EntityId", "EntityType", "Amount", "TaxAmount", "DueDate", "IsActive"))


def materialize(tables: dict[str, DataFrame], out_dir: str, names=CONTRACT_TABLES) -> None:
    """Write the contract tables as parquet, receivables and details clustered on their join key
    so later reads can use sorted, pruned files."""
    for n in names:
        df = tables[n]
        if n == "receivables":
            df = df.repartition("Id").sortWithinPartitions("EntityId", "Id")
        elif n == "receivabledetails":
            df = df.repartition("ReceivableId").sortWithinPartitions("ReceivableId")
        df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{n}")


# Buckets and sort keys of saved tables: what the report joins receivables and details on
BUCKETS = {"receivables": "Id", "receivabledetails": "ReceivableId", "leasefinances": "ContractId", "loanfinances": "ContractId", "contracts": "Id"}


def save_bucketed(tables: dict[str, DataFrame], database: str, buckets: int, names=CONTRACT_TABLES) -> None:
    """The contract tables as tables of a catalog, those that are joined again and again bucketed and sorted by
    their key, so that their joins need no exchange. ``buckets``: for big data, table bytes / 256 MB or so."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for n in names:
        df, key = tables[n], BUCKETS.get(n)
        # one writer for each bucket, so that a bucket is one sorted file
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) if key else df.write
        writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{n}")


def bucketed_tables(spark: SparkSession, database: str, names=CONTRACT_TABLES) -> dict[str, DataFrame]:
    return {n: spark.table(f"{database}.{n}") for n in names}


def derive_requests(customer: DataFrame) -> DataFrame:
    """A batch of questions derived from the customer table: one request per customer, for contract
    number ``custkey * 11`` (about one in eleven does not exist), with padding to strip, an intent
    chosen by key and an as-of date up to 399 days before ``AS_OF``."""
    from ledgerguard.operators.contracts import INTENTS
    key = F.col("c_custkey")
    intents = F.array(*[F.lit(i) for i in INTENTS])
    return customer.select(
        key.alias("request_id"),
        F.concat(F.lit(" CT-"), (key * 11).cast("string"), F.lit(" ")).alias("seq"),
        F.element_at(intents, (key % len(INTENTS) + 1).cast("int")).alias("intent"),
        F.date_sub(F.lit(AS_OF), (key % 400).cast("int")).alias("as_of"))
