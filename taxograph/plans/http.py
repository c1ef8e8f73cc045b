"""A thin HTTP and websocket front end of an engine, from the standard library."""

from __future__ import annotations

import base64
import hashlib
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from taxograph.plans.engine import Engine
from taxograph.plans.requests import RequestError, Transport

#: Fixed value of the websocket protocol (RFC 6455).
KEY_SUFFIX = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, CLOSE = 0x81, 0x88


def accept_key(key: str) -> str:
    """What a server answers to the key of a client's handshake."""
    return base64.b64encode(hashlib.sha1((key + KEY_SUFFIX).encode()).digest()).decode()


def frame(kind: int, data: bytes) -> bytes:
    """One unmasked frame, as a server sends it."""
    n = len(data)
    if n < 126:
        return struct.pack("!BB", kind, n) + data
    return (struct.pack("!BBH", kind, 126, n) if n < 1 << 16 else struct.pack("!BBQ", kind, 127, n)) + data


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet running: ``/?c1=...`` answers a request, ``/status`` gives the status document.

    A request that is not answered has status 500. A websocket gets the queue and progress messages too, each message as one
    frame, and is closed after the answer; one that is not answered is closed at once. Port 0 takes a free one.
    """

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            if url.path == "/status":
                self._send(200, "application/json", engine.status())
                return
            params = dict(parse_qsl(url.query, keep_blank_values=True))
            if self.headers.get("Upgrade", "").lower() == "websocket":
                self._socket(params)
                return
            try:
                text = "".join(engine.submit(params).result())
            except RequestError as error:
                self._send(500, "text/plain", f"{error}\n")
                return
            self._send(200, "application/javascript" if params.get("t") == Transport.JS.value else "text/plain", text)

        def _socket(self, params: dict[str, str]) -> None:
            self.close_connection = True
            self.wfile.write(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept_key(self.headers.get('Sec-WebSocket-Key', ''))}\r\n\r\n".encode())
            lock = threading.Lock()

            def tell(text: str) -> None:
                with lock:
                    self.wfile.write(frame(TEXT, text.encode()))

            try:
                for line in engine.follow(engine.submit(params, socket=True, tell=tell), tell):
                    tell(line)
            except (RequestError, ConnectionError):
                pass
            try:
                self.wfile.write(frame(CLOSE, struct.pack("!H", 1000)))
            except ConnectionError:
                pass

        def _send(self, code: int, kind: str, text: str) -> None:
            body = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
