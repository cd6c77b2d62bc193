"""Requests and replies as JSON over a store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.statistic import available, calculate
from tidewell.operators.layout import is_reading
from tidewell.plans.storage import Status, Store
from tidewell.types import MAX_ID, clamp_time


class RequestError(ValueError):
    """Status 400, or 404 for an unknown type."""

    def __init__(self, status: int, text: str) -> None:
        super().__init__(text)
        self.status = status


def series_json(rows: DataFrame, names: DataFrame) -> DataFrame:
    """name, json: each series' rows in order of time as [{F, T, V}, ...]. rows: id, time, value, flag. names: id, name."""
    row = F.struct(F.col("flag").alias("F"), F.col("time").alias("T"), F.col("value").alias("V"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("time", row.alias("r")))).alias("rs"))
    return listed.join(names, "id").select("name", F.to_json(F.transform("rs", lambda x: x["r"])).alias("json"))


def appended(request: dict) -> list[tuple[str, int, float, int]]:
    """Rows (name, time, value, flag) of an append request, single or columnar."""
    out = []
    try:
        if "append_value" in request:
            v = request["append_value"]
            out.append((v["I"], int(v["T"]), float(v["V"]), int(v.get("F", 0))))
        for name, v in request.get("append_values", {}).items():
            if not len(v["F"]) == len(v["T"]) == len(v["V"]):
                raise RequestError(400, f"{name}: arrays of different lengths")
            out += [(name, int(t), float(x), int(f)) for f, t, x in zip(v["F"], v["T"], v["V"])]
    except (KeyError, TypeError, ValueError) as e:
        raise e if isinstance(e, RequestError) else RequestError(400, f"bad append: {e!r}") from e
    if not out and "append_values" not in request:
        raise RequestError(400, "nothing to append")
    return out


class JsonApi:
    """Answers requests of the types append, readInterval, readTimepoint, stat, scheme, statistic and erase."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def handle(self, request: str | dict) -> tuple[int, str]:
        """(status, reply): 200; 400 a request that can't be read; 404 an unknown type."""
        try:
            q = json.loads(request) if isinstance(request, str) else request
            kind = q["type"]
        except (ValueError, KeyError, TypeError):
            return 400, ""
        f = getattr(self, f"_{kind.lower()}", None) if isinstance(kind, str) else None
        if kind not in ("append", "readInterval", "readTimepoint", "stat", "scheme", "statistic", "erase") or f is None:
            return 404, ""
        try:
            return 200, f(q)
        except RequestError as e:
            return e.status, str(e)
        except (KeyError, TypeError, ValueError) as e:
            return 400, repr(e)

    def get(self, path: str) -> tuple[int, str]:
        """/scheme: names and ids; /statfuncs: functions; anything else: no content."""
        if path == "/scheme":
            return 200, json.dumps(self.store.scheme.names())
        if path == "/statfuncs":
            return 200, json.dumps({"functions": available()})
        return 204, ""

    def _ids(self, names) -> dict[int, str]:
        return {i: n for n in ([names] if isinstance(names, str) else names) if (i := self.store.scheme.id_of(n)) != MAX_ID}

    def _append(self, q: dict) -> str:
        out = Status()
        for name, t, v, f in appended(q):
            out = out + self.store.append(self.store.scheme.add(name), t, v, f)
        return json.dumps({"writed": out.writed, "ignored": out.ignored, "error": out.error})

    def _listed(self, rows: DataFrame, ids: dict[int, str]) -> str:
        out: dict[str, list] = {n: [] for n in ids.values()}
        for r in rows.toLocalIterator():
            out[ids[r["id"]]].append({"F": r["flag"], "T": r["time"], "V": r["value"]})
        return json.dumps({n: v for n, v in out.items() if v})

    def _readinterval(self, q: dict) -> str:
        ids = self._ids(q["id"])
        return self._listed(self.store.read_interval(ids, int(q["from"]), int(q["to"]), int(q.get("flag", 0))), ids) if ids else "{}"

    def _readtimepoint(self, q: dict) -> str:
        ids = self._ids(q["id"])
        return self._listed(self.store.read_time_point(ids, int(q["time"]), int(q.get("flag", 0))), ids) if ids else "{}"

    def _stat(self, q: dict) -> str:
        ids = self._ids(q["id"])
        out = {}
        for i, n in ids.items():
            r = self.store.stat(i, int(q["from"]), clamp_time(q["to"])).first()
            out[n] = {k: r[c] if r else 0 for k, c in (("count", "count"), ("maxTime", "max_time"), ("maxValue", "max_value"), ("minTime", "min_time"), ("minValue", "min_value"), ("sum", "sum"))}
        return json.dumps(out)

    def _scheme(self, q: dict) -> str:
        return json.dumps(self.store.scheme.add_all(q["add"]))

    def _statistic(self, q: dict) -> str:
        ids = self._ids(q["id"])
        rows = self.store.read_interval(ids, int(q["from"]), int(q["to"]), int(q.get("flag", 0))).where(is_reading())
        got = sorted(calculate(rows, q["functions"]).collect(), key=lambda r: r["ord"]) if ids and q["functions"] else []
        return json.dumps({r["fn"]: {"F": r["flag"], "T": r["time"], "V": r["value"]} for r in got}) if got else ""

    def _erase(self, q: dict) -> str:
        for i in self._ids(q["id"]):
            self.store.erase_old(i, clamp_time(q["to"]))
        return "{}"


def serve(api: JsonApi, port: int, host: str = "127.0.0.1"):
    """An HTTP server for `api`: POST with a request as its body, GET /scheme and /statfuncs. Call its serve_forever()."""
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:  # noqa: N802
            self._send(*api.handle(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode(errors="replace")))

        def do_GET(self) -> None:  # noqa: N802
            self._send(*api.get(self.path))

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)
