"""Golden answers of the 12-contract fixture (each contract pins one rule) for the four core questions,
through both the per-question operators and the portfolio report."""
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerguard.operators import contracts as K
from tests.fixtures.seed import AS_OF, GOLDEN


def _by_seq(df, seq_col="SequenceNumber"):
    return {r[seq_col]: r for r in df.collect()}


def _ids(seed):
    return {r.Id: r.SequenceNumber for r in seed["contracts"].collect()}


def test_status(seed):
    got = _by_seq(K.contract_status(seed["contracts"]))
    for seq, g in GOLDEN.items():
        assert (got[seq].Status, got[seq].WorkflowStatus) == (g[0], g[1])


def test_next_due(seed):
    ids = _ids(seed)
    got = {ids[r.ContractId]: r for r in K.next_due_total(seed["receivables"], seed["receivabledetails"]).collect()}
    for seq, g in GOLDEN.items():
        if g[2] is None:
            assert seq not in got, seq            # no row when there is nothing unbilled
        else:
            assert got[seq].NextDueDate == date.fromisoformat(g[2]) and got[seq].NextDueTotal == g[3], seq


def test_invoices(seed):
    ids = _ids(seed)
    inv = K.invoice_amount(seed["leasefinances"], seed["leasefundings"], seed["payableinvoices"]).collect()
    got = {ids[r.ContractId]: r for r in inv}
    for seq, g in GOLDEN.items():
        if g[4] == 0:
            assert seq not in got
        else:
            assert (got[seq].InvoiceCount, got[seq].InvoiceAmount, got[seq].InvoiceTaxAmount) == (g[4], g[5], g[6])


def test_outstanding_inclusive_as_of(seed):
    ids = _ids(seed)
    got = {ids[r.ContractId]: r.OutstandingTotal for r in
           K.outstanding_amount(seed["contracts"], seed["receivables"], seed["receivabledetails"], AS_OF).collect()}
    assert got == {seq: g[7] for seq, g in GOLDEN.items()}


def test_outstanding_other_as_of(seed):
    ids = _ids(seed)
    got = {ids[r.ContractId]: r.OutstandingTotal for r in
           K.outstanding_amount(seed["contracts"], seed["receivables"], seed["receivabledetails"],
                                date(2026, 9, 2)).collect()}
    assert got["CT-1001"] == D("1080.00")


def test_portfolio_report_matches_golden(seed):
    rep = _by_seq(K.portfolio_report(seed, AS_OF))
    assert list(rep) == sorted(GOLDEN)
    for seq, g in GOLDEN.items():
        r = rep[seq]
        status = "not yet commenced" if g[0] == "Not yet commenced" else g[0]
        assert r.Status == status and r.WorkflowStatus == g[1]
        assert (r.NextDueDate.isoformat() if r.NextDueDate else None) == g[2]
        assert r.NextDueTotal == g[3]
        assert (r.InvoiceCount, r.InvoiceAmount, r.InvoiceTaxAmount) == (g[4], g[5], g[6])
        assert r.OutstandingTotal == g[7]


def test_unknown_contract_and_resolution(spark, seed):
    req = spark.createDataFrame([(1, " CT-1001 ", "status", AS_OF), (2, "CT-9999", "status", AS_OF)],
                                "request_id long, seq string, intent string, as_of date")
    assert [r.request_id for r in K.resolve_contracts(req, seed["contracts"]).collect()] == [1]
    assert [r.seq for r in K.unknown_contracts(req, seed["contracts"]).collect()] == ["CT-9999"]
    ans = {r.request_id: r for r in K.answer_requests(req, seed).collect()}
    assert ans[1].outcome == "answered" and '"Status":"Commenced"' in ans[1].rows_json
    assert ans[2].outcome == "not_found" and ans[2].row_count == 0


def test_adhoc_facts(seed):
    ids = _ids(seed)
    facts = {ids[r.ContractId]: r for r in K.contract_facts(seed["contracts"], seed["leasefinances"],
                                                            seed["loanfinances"], seed["customers"]).collect()}
    assert facts["CT-1001"].CommencementDate == date(2026, 5, 1) and facts["CT-1001"].DownPayment == D("5000.00")
    assert facts["CT-1003"].ContractType == "Loan" and facts["CT-1002"].BookingDate == date(2026, 5, 25)
    paid = {ids[r.ContractId]: r.PaidReceivables for r in
            K.paid_receivable_count(seed["contracts"], seed["receivables"], seed["receivabledetails"]).collect()}
    assert paid["CT-1001"] == 4
    blocked = {ids[r.ContractId]: r.BlockedLines for r in
               K.blocked_line_count(seed["contracts"], seed["receivables"], seed["receivabledetails"]).collect()}
    assert blocked["CT-1009"] == 2
    fin = {ids[r.ContractId]: r for r in K.invoice_max_final_due(
        seed["contracts"], seed["receivables"], seed["leasefinances"], seed["leasefundings"], seed["payableinvoices"]).collect()}
    assert fin["CT-1004"].FinalDueDate == date(2026, 9, 1) and fin["CT-1006"].LargestInvoice == D("30000.00")
    od = [(r.DueDate.isoformat(), r.Balance) for r in K.overdue_receivables(seed["receivables"], seed["receivabledetails"], AS_OF).collect()
          if ids[r.ContractId] == "CT-1011"]
    assert od == [("2026-08-01", D("240.00")), ("2026-09-01", D("1620.00")), ("2026-10-01", D("1620.00"))]
