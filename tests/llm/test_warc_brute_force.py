"""Derived records of whole tables against the standard library's HTML parser, and pages that are made to be slow."""

import base64
import hashlib
import os
import time
import uuid
from html.parser import HTMLParser

import pytest

from siftmill.llm import queries, warc

SF = "/root/testdata/sf0.001"
BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav header footer title head body html blockquote pre hr dt dd dl form option td th".split())


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.hidden, self.inside = [], [], None, 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template", "noscript")
        self.text += ["\n"] * (tag in BLOCKS)
        self.inside = self.inside or tag == "title"
        if tag == "a" and dict(attrs).get("href") is not None and not self.hidden:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template", "noscript")
        self.text += ["\n"] * (tag in BLOCKS)
        self.inside = self.inside and tag != "title"

    def handle_data(self, data):
        if self.hidden:
            self.text.append(" ")
            return
        self.text.append(data)
        if self.inside:
            self.title = " ".join(((self.title or "") + data).split())


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_brute_force(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    built = warc.build_warc(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    told = {(r["page_id"], r["record_type"]): r for r in queries.op7_warc_derivatives(spark, SF).collect()}
    assert len(built) == len(told) == 3 * len(pages)
    for r in built:
        page, raw = pages[r["page_id"]]["html"] or "", (pages[r["page_id"]]["html"] or "").encode()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        body = rest[:-4]
        rid = f"<urn:uuid:{uuid.uuid5(warc.NAMESPACE, '|'.join(('response', str(r['page_id']), pages[r['page_id']]['url'] or '', sha(raw))))}>"
        assert rest.endswith(b"\r\n\r\n") and lines["Content-Length"] == str(len(body)) == str(r["content_length"]) and lines["WARC-Block-Digest"] == sha(body)
        assert lines["WARC-Target-URI"] == (pages[r["page_id"]]["url"] or "") and lines["WARC-Type"] == r["record_type"]
        reader = Reader()
        reader.feed(page)
        reader.close()
        if r["record_type"] == "response":
            assert lines["WARC-Record-ID"] == rid and "WARC-Refers-To" not in lines and body.endswith(raw) and lines["WARC-Payload-Digest"] == sha(raw)
        else:
            assert lines["WARC-Refers-To"] == rid and lines["WARC-Record-ID"] != rid
        if r["record_type"] == "conversion":
            want = [" ".join(x.split()) for x in "".join(reader.text).split("\n")]
            assert body.decode() == "\n".join(x for x in want if x)
        if r["record_type"] == "metadata":
            fields = [x.split(": ", 1) for x in body.decode().split("\r\n") if x]
            assert [v for k, v in fields if k == "outlink"] == [" ".join(x.split()) for x in reader.links]
            assert dict(fields).get("title") == reader.title and dict(fields)["source-payload-digest"] == sha(raw)
        same = told[r["page_id"], r["record_type"]]
        assert all(same[c] == r[c] for c in ("record_id", "refers_to", "block_digest", "content_length")) and same["record_sha256"] == hashlib.sha256(bytes(r["record"])).hexdigest()


@pytest.mark.parametrize("part", ["<!--", "<a ", "<p ", "<title>", "<html lang", "<script>", "<a href=", "&amp;<", "</"])
def test_hostile_pages_cost_their_length(part):
    start = time.monotonic()
    rid, headers, block, _ = warc.response(1, "u", part * 150_000)
    made = warc.derivatives(warc.serialise(headers, block))
    assert [x[0] for x in made] == ["metadata", "conversion"] and time.monotonic() - start < 20
