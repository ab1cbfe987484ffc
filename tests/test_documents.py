from textwarden.plans import catalogue


def test_masked_kinds_and_numbers(spark):
    rows = [(1, "Call 408-555-0101 or write to a@b.org and c@d.org; again a@b.org."), (2, "Take 2,5 mg or 1,000 mL, half a tablet, 0.50 and twelve."), (3, "Nothing here."), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {(r.doc_id, r.kind): r.n for r in catalogue.masked_kinds(docs).collect()}
    assert kinds == {(1, "PHONE"): 1, (1, "EMAIL"): 2}
    numbers = {(r.doc_id, r.number) for r in catalogue.number_values(docs).collect()}
    assert {n for d, n in numbers if d == 2} >= {"2.5", "1000", "0.5"} and not any(d in (3, 4) for d, _ in numbers)
    assert {"mask_counts_all_kinds", "number_values_in_documents"} <= set(catalogue.QUERIES)
