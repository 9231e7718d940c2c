"""What plans of the training-data queries must not do."""

from atomweave.llm import topk


def test_copies_of_queries_are_not_broadcast(spark):
    """The planner's size of the query chunks leaves out their copies, so a broadcast would put all of them into the driver."""
    found = topk.op3_topk(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
