"""Table functions against the column expressions."""

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import sql
from kilnwork.operators import extract

TEXTS = [
    None, "", "nothing", "<tr><td>tool_name</td></tr><tr><td> a </td><td>b **c**</td></tr><TR><td></td></TR><tr>x</tr>", "<tool_name>f</tool_name> one\ntwo<tool_name> </tool_name> x <tool_name>g</tool_name> end\nPlease use the following format: z",
    "\\begin{tabular}{ll} tool_name & x \\\\ \\hline ff & y \\\\ a & b \\\\ no \\end{tabular}", "ff & y \\\\ gg & z", "- **tool_name**: get_it\nsays\n* tool_name: other\r\nrest\nShould you decide not", "tool_name:   \nTool_Name: é ü\n",
]


@pytest.mark.parametrize("name", sorted(sql.WRITTEN))
def test_table_functions_equal_expressions(spark, name):
    assert name in sql.register_tables(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, system string")
    df.createOrReplaceTempView("prompts")
    got = spark.sql(f"SELECT p.id, x.position, x.tool FROM prompts p, LATERAL {name}(p.system) x").collect()
    want = df.select("id", F.posexplode(getattr(extract, name)(F.col("system"))).alias("position", "tool")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    plan = spark.sql(f"SELECT p.id, x.tool FROM prompts p, LATERAL {name}(p.system) x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_table_functions_beside_other_tables(spark):
    sql.register_tables(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "id int, system string").createOrReplaceTempView("prompts")
    got = spark.sql("SELECT p.id, count(*) AS n FROM prompts p, LATERAL name_block_tools(p.system) x WHERE x.position < 5 GROUP BY p.id").collect()
    assert {r.id: r.n for r in got} == {7: 2, 8: 1}
