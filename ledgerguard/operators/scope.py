"""Contract scope: restricted projection (P1), contract-scoped views (J7) and rows outside scope.

A query may only see rows tied to a contract: anchored on a contract key, reaching other tables only
over foreign-key edges, receivables only with ``EntityType = 'CT'``. Instead of checking query text,
every table is published as a view tagged with ``contract_id``; a breadth-first walk over the
foreign-key graph from the anchor tables builds each view as a chain of joins. A customer with two
contracts appears once per contract. Restricted columns are never in a published view.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions.patterns import RESTRICTED_COLUMNS

# Contract keys and foreign-key edges of the contract schema
CONTRACT_KEYS = {
    "contracts": "Id",
    "leasefinances": "ContractId",
    "loanfinances": "ContractId",
    "receivables": "EntityId",
}
FK_EDGES = (
    (("leasefinances", "ContractId"), ("contracts", "Id")),
    (("loanfinances", "ContractId"), ("contracts", "Id")),
    (("leasefinances", "CustomerId"), ("customers", "Id")),
    (("loanfinances", "CustomerId"), ("customers", "Id")),
    (("leasefundings", "LeaseFinanceId"), ("leasefinances", "Id")),
    (("leasefundings", "PayableInvoiceId"), ("payableinvoices", "Id")),
    (("receivabledetails", "ReceivableId"), ("receivables", "Id")),
    (("receivables", "EntityId"), ("contracts", "Id")),
)
ROW_KEYS = {
    "contracts": ["Id"], "customers": ["Id"], "leasefinances": ["Id"], "loanfinances": ["Id"],
    "payableinvoices": ["Id"], "leasefundings": ["LeaseFinanceId", "PayableInvoiceId"],
    "receivables": ["Id"], "receivabledetails": ["ReceivableId", "DueDate", "Amount", "TaxAmount", "Balance",
                                                 "BillingStatus", "IsTaxAssessed"],
}


def drop_restricted(df: DataFrame, table: str, restricted=None) -> DataFrame:
    """The published view of a table never carries a restricted column."""
    restricted = RESTRICTED_COLUMNS if restricted is None else restricted
    drop = [c for c in df.columns if (table.lower(), c.lower()) in restricted]
    return df.drop(*drop)


def _anchor(table: str, df: DataFrame) -> DataFrame:
    if table == "receivables":
        df = df.where(F.col("EntityType") == "CT")
    return df.withColumn("contract_id", F.col(CONTRACT_KEYS[table]))


def contract_scope(tables: dict, contract_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """``table -> DataFrame(contract_id, <table columns without restricted ones>)`` for all eight tables.
    ``contract_ids`` (optional, column ``contract_id``) limits the scope to those contracts (semi join)."""
    scoped: dict[str, DataFrame] = {}
    for t in CONTRACT_KEYS:
        df = _anchor(t, tables[t])
        if contract_ids is not None:
            df = df.join(contract_ids.select("contract_id").distinct(), "contract_id", "left_semi")
        scoped[t] = df
    frontier = set(scoped)
    while frontier:
        reached: dict[str, list[DataFrame]] = {}
        for (a, acol), (b, bcol) in FK_EDGES:
            for (src, scol), (dst, dcol) in (((a, acol), (b, bcol)), ((b, bcol), (a, acol))):
                if src in frontier and dst not in scoped:
                    keys = scoped[src].select("contract_id", F.col(scol).alias("_k"))
                    if not (scol == "Id" and src in CONTRACT_KEYS):  # a primary key of a table with its own contract key is distinct
                        keys = keys.distinct()
                    reached.setdefault(dst, []).append((dcol, keys))
        for dst, ways in reached.items():
            if len(ways) > 1 and len({dcol for dcol, _ in ways}) == 1:  # distinct before the join: keys and rows, not their pairs
                keys = reduce(DataFrame.unionByName, [k for _, k in ways]).distinct()
                scoped[dst] = tables[dst].distinct().join(keys, F.col(ways[0][0]) == F.col("_k")).drop("_k")
                continue
            parts = [tables[dst].join(keys, F.col(dcol) == F.col("_k")).drop("_k") for dcol, keys in ways]
            scoped[dst] = reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]
        frontier = set(reached)
    out = {}
    for t, df in scoped.items():
        cols = [c for c in tables[t].columns]
        out[t] = drop_restricted(df.select("contract_id", *cols), t)
    return out


def out_of_scope_rows(tables: dict) -> DataFrame:
    """Rows that no contract reaches (e.g. SU receivables, customers without a finance record)."""
    scoped = contract_scope(tables)
    parts = []
    for t, keys in ROW_KEYS.items():
        inside = scoped[t].select(*keys)
        missing = tables[t].join(inside, keys, "left_anti")
        parts.append(missing.select(F.lit(t).alias("TableName"),
                                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("RowKey")))
    return reduce(DataFrame.unionByName, parts)
