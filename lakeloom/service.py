"""The lineage service over HTTP: ``python -m lakeloom.service [port]``.

GET /health, POST /api/lineage/{extract,tables,columns} with {"sql", "connectorType", "connectorConfig"}; JSON in and out. Analysis
runs on the driver's session; requests come in threads of their own.
"""

from __future__ import annotations

import json
import logging
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from lakeloom.plans import report

_LOG = logging.getLogger(__name__)
LONGEST = 16 << 20  # bytes of a request


def serve(spark: SparkSession, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server bound to a port (0: a free one, see ``server_port``); ``serve_forever`` starts it, ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, value: dict) -> None:
            body = report.to_json(value).encode()
            self.send_response(value.get("statusCode", 200) if value.get("error") else 200)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(report.answer(spark, self.path if self.path == "/health" else f"{self.path} ", {}))

        def do_POST(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > LONGEST:
                    raise report.BadRequest(f"a request of more than {LONGEST} bytes")
                request = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(request, dict):
                    raise report.BadRequest("a JSON object is wanted")
            except (ValueError, UnicodeDecodeError) as e:
                self._send(report.error(e if isinstance(e, report.BadRequest) else report.BadRequest(str(e))))
                return
            self._send(report.answer(spark, self.path if self.path != "/health" else "/health ", request))

        def log_message(self, form: str, *args: object) -> None:
            _LOG.info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str]) -> None:
    logging.basicConfig(level=logging.INFO)
    serve(SparkSession.builder.getOrCreate(), int(args[0]) if args else 8080).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
