"""A paged service in this process, read by Spark's tasks."""

import collections
import http.server
import json
import threading
import urllib.parse

import pytest

from stridewell.sources import service

TOKEN = "s3cret-token"


@pytest.fixture
def served():
    """Holds what the service has and how it behaves; ``asked`` counts requests per page."""
    state = {"rows": [], "asked": collections.Counter(), "fail": {}, "total": True, "auth": set()}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            page, size = int(q["page"]), int(q["per_page"])
            state["asked"][page] += 1
            state["auth"].add(self.headers.get("Authorization"))
            codes = state["fail"].get(page, [])
            if codes:
                self.send_response(codes.pop(0))
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            body = json.dumps(state["rows"][(page - 1) * size:page * size]).encode()
            self.send_response(200)
            if state["total"]:
                self.send_header("X-Total-Count", str(len(state["rows"])))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/athlete/activities?kind=all"
    yield state
    server.shutdown()


def row(i):
    return {"id": i, "name": f'ride "{i}"', "type": "Ride", "start_date": "2024-01-01", "elapsed_time": i * 1.5, "distance": None, "average_heartrate": "x" if i == 3 else 120, "other": [1]}


@pytest.fixture
def token(monkeypatch, tmp_path):
    path = tmp_path / "token"
    path.write_text(TOKEN + "\n")
    return str(path)


@pytest.mark.parametrize("total", [True, False])
def test_all_pages_are_read_once(spark, served, token, total):
    served |= {"rows": [row(i) for i in range(57)], "total": total, "fail": {3: [503, 429], 6: [500]}}
    df = service.fetch_activities(spark, served["url"], token_file=token, per_page=5, pages_per_task=3, pause=0.01)
    assert TOKEN not in df._jdf.queryExecution().toString()
    got = sorted(df.collect())
    assert [r.id for r in got] == list(range(57)) and got[4].name == 'ride "4"' and got[4].elapsed_time == 6.0
    assert got[3].average_heartrate is None and got[5].average_heartrate == 120.0 and got[5].distance is None
    assert served["auth"] == {f"Bearer {TOKEN}"}
    if total:  # the count is asked once, with the first page; each page once, and once more per failure
        assert served["asked"] == {1: 2, 2: 1, 3: 3, **dict.fromkeys((4, 5), 1), 6: 2, **dict.fromkeys(range(7, 13), 1)}


def test_a_fetch_goes_on_where_it_broke_off(spark, served, tmp_path):
    served |= {"rows": [row(i) for i in range(20)], "fail": {4: [503] * 30}}
    read = lambda: service.fetch_activities(spark, served["url"], kept=str(tmp_path / "kept"), per_page=4, pages_per_task=1, retries=1, pause=0.01)
    with pytest.raises(Exception, match="page 4: the service answers 503"):
        read().collect()
    served["fail"] = {}
    served["asked"].clear()
    assert sorted(r.id for r in read().collect()) == list(range(20))
    assert served["asked"][4] == 1 and served["asked"][1] == 0 and sum(served["asked"].values()) <= 2
    served["asked"].clear()
    assert read().count() == 20 and not served["asked"]


def test_refusals_and_nothing(spark, served, monkeypatch):
    assert service.fetch_activities(spark, served["url"]).count() == 0
    served |= {"total": False}
    assert service.fetch_activities(spark, served["url"]).count() == 0
    served |= {"fail": {1: [401] * 9}}
    with pytest.raises(Exception, match="answers 401"):
        service.fetch_activities(spark, served["url"], pause=0.01).collect()
    assert served["asked"][1] <= 4  # not tried again
    monkeypatch.delenv("NO_SUCH_TOKEN", raising=False)
    with pytest.raises(Exception, match="NO_SUCH_TOKEN"):
        service.fetch_activities(spark, served["url"], token_env="NO_SUCH_TOKEN").collect()
