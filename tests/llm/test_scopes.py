from __future__ import annotations

import threading

from stripmill.llm.common import cut_table, scope


def test_scopes_of_two_threads_leave_each_others_tables_alone(spark):
    made, other_is_done, failed = threading.Event(), threading.Event(), []

    def first():
        try:
            with scope(spark) as stays:
                gone, kept = cut_table(spark.range(5)), stays(cut_table(spark.range(7)))
                made.set()
                other_is_done.wait(60)
                assert gone.count() == 5
            assert kept.count() == 7
        except BaseException as e:  # noqa: BLE001  told to the test's own thread
            failed.append(e)

    thread = threading.Thread(target=first)
    thread.start()
    made.wait(60)
    with scope(spark):
        cut_table(spark.range(3))
    other_is_done.set()
    thread.join(120)
    assert not failed
