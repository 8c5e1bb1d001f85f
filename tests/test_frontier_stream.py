import json
import time

import pytest

from lettera.streaming import frontier_stream as S


@pytest.fixture()
def crawl(spark, tmp_path):
    """run(events, ...) puts events into one file and gives the claims of the batches that the stream then makes, in the order of files."""
    (tmp_path / "events").mkdir()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen, n = set(), [0]

    def run(events, **limits):
        scope = {k: limits.pop(k) for k in ("shards", "hosts", "deny") if k in limits}
        n[0] += 1
        (tmp_path / "events" / f"{n[0]}.json").write_text("\n".join(json.dumps(e) for e in events))
        query = S.start(spark, f"{tmp_path}/events", f"{tmp_path}/claims", f"{tmp_path}/check", S.Limits(**limits), **scope)
        try:
            # timers keep the stream going, so it is done when the events are in and another batch has ended
            end = time.time() + 40
            while time.time() < end and query.exception() is None:
                done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
                if done and query.lastProgress["batchId"] > done[-1]:
                    break
                time.sleep(0.2)
            assert query.exception() is None and time.time() < end
        finally:
            query.stop()
        rows = [r for r in spark.read.schema(S.CLAIM).parquet(f"{tmp_path}/claims").collect()]
        new = [r for r in rows if (r.url, r.state, r.attempts) not in seen]
        seen.update((r.url, r.state, r.attempts) for r in new)
        return sorted((r.url.removeprefix("http://"), r.state, r.attempts) for r in new)

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", before)


def found(url, seq, depth=0, priority=0):
    return {"event": "found", "url": f"http://{url}", "depth": depth, "priority": priority, "discovered_from": "", "seq": seq}


def result(url, how="done", documents=0):
    return {"event": "result", "url": f"http://{url}", "result": how, "documents": documents}


LONG = 10_000_000


def test_claims_by_priority_depth_and_order_and_once(crawl):
    first = crawl([found("a/1", 1), found("a/2", 2, depth=1, priority=5), found("a/3", 3, priority=5), found("a/1", 4, priority=99), found("b/1", 5), found("b/9", 6, depth=13), found("x/1", 7), found("A:80/3", 8)], wave=2, delay=0, lease=LONG, hosts=["a", "b"])
    assert first == [("a/2", "active", 1), ("a/3", "active", 1), ("b/1", "active", 1), ("b/9", "skipped", 0)]
    # a link that comes late and is known does nothing, one that is new takes its place; results make room for the rest
    assert crawl([found("a/3", 9), found("a/4", 10, priority=1), result("a/2"), result("a/3", "failed"), result("b/9")], wave=2, delay=0, lease=LONG, hosts=["a", "b"]) == [("a/1", "active", 1), ("a/4", "active", 1)]
    assert crawl([result("a/1"), result("a/4"), found("a/2", 11)], wave=2, delay=0, lease=LONG, hosts=["a", "b"]) == []


def test_budgets_end_a_hosts_claims(crawl):
    urls = [found(f"{h}/{k}", k) for h in "ab" for k in range(1, 8)]
    limits = dict(wave=2, delay=0, lease=LONG, max_urls=3, max_documents=4)
    assert crawl(urls, **limits) == [("a/1", "active", 1), ("a/2", "active", 1), ("b/1", "active", 1), ("b/2", "active", 1)]
    # a has one success left; b has its documents
    assert crawl([result("a/1"), result("a/2"), result("b/1", documents=9)], **limits) == [("a/3", "active", 1)]
    assert crawl([result("a/3"), result("b/2"), found("a/9", 99), found("c/1", 1)], **limits) == [("c/1", "active", 1)]


def test_a_claim_without_a_result_is_made_again_after_its_lease(crawl):
    limits = dict(wave=1, delay=0, lease=8000)
    assert ("a/1", "active", 1) in crawl([found("a/1", 1)], **limits)
    time.sleep(8)
    again = crawl([found("b/1", 2)], **limits)
    assert any(u == "a/1" and n > 1 for u, _, n in again) and ("b/1", "active", 1) in again


def test_delay_and_time_budget(crawl):
    assert crawl([found("a/1", 1), found("a/2", 2)], wave=1, delay=LONG, lease=LONG) == [("a/1", "active", 1)]
    assert crawl([result("a/1")], wave=1, delay=LONG, lease=LONG) == []
    assert crawl([found("b/1", 1), found("b/2", 2)], wave=1, delay=0, lease=LONG, time_budget=1) == [("b/1", "active", 1)]
    time.sleep(0.1)
    assert crawl([result("b/1")], wave=1, delay=0, lease=LONG, time_budget=1) == []


def test_shards_claim_each_url_once(crawl):
    urls = [found(f"a/{k}", k) for k in range(40)]
    got = crawl(urls + urls, wave=400, delay=0, lease=LONG, shards=4)
    assert got == sorted((f"a/{k}", "active", 1) for k in range(40))
