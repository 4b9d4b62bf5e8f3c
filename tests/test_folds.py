"""The folds that have no SQL, against plain loops over the same rows."""

import re
from collections import defaultdict

from pagemill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_reading_order(spark):
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").collect():
        orders[r.l_orderkey].append((r.l_quantity + 2.5, r.l_partkey, r.l_linenumber, r.l_quantity, r.l_quantity + 5, r.l_extendedprice))
    for r in catalog.reading_order(spark, FOLDER).collect():
        rows = []
        for box in sorted(orders[r.l_orderkey]):
            if rows and rows[-1][0][3] <= box[0] <= rows[-1][0][4]:
                rows[-1].append(box)
            else:
                rows.append([box])
        assert r.reading == "\n".join(" ".join(str(b[1]) for b in sorted(row, key=lambda b: (b[5], b[1], b[2]))) for row in rows)


def test_greedy_wrap(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in catalog.greedy_wrap(spark, FOLDER).collect():
        used = lines = 0
        for word in [w for w in re.sub(r"[ \t\n\x0b\f\r]+", " ", texts[r.doc_id]).split(" ") if w]:
            if used and used + 1 + len(word) <= 40:
                used += 1 + len(word)
                continue
            lines += 1
            while len(word) > 40:
                word, lines = word[40:], lines + 1
            used = len(word)
        assert r.n_lines == lines
