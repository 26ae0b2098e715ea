import pytest
from oracle import FOLDER, compare

from chorale.llm import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows_as_sql(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLE[name])


FOUND = {
    "p1_found": ["table_name", "group_id", "best_record_id", "year_record_id"], "p4_found": ["name_kind", "name_a", "name_b"], "p5_found": ["first_record_id", "record_id"], "p6_found": ["record_a", "record_b"],
    "p7_found": ["discogs_record_id", "video_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_no_row_twice(spark, name):
    df = plans.QUERIES[name](spark, FOLDER)
    assert df.columns == FOUND[name] and {t for _, t in df.dtypes} <= {"string", "bigint"}
    rows = df.collect()
    assert len(set(rows)) == len(rows)
