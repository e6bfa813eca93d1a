"""Pages of some endpoints, as a fetch function for the harvest's tests."""

import json
import os
import time

RECORD = "<oai:record><oai:header><oai:identifier>{0}</oai:identifier></oai:header><oai:metadata><dc:title>t {0}</dc:title><dc:identifier>https://doi.org/10.1/{0}</dc:identifier></oai:metadata></oai:record>"
broken = {"so02": True}


def page(ids, token):
    return 200, f"<oai:OAI xmlns:oai='o' xmlns:dc='d'><oai:ListRecords>{''.join(RECORD.format(i) for i in ids)}<oai:resumptionToken>{token}</oai:resumptionToken></oai:ListRecords></oai:OAI>"


def fetch(url, token):
    code = url.split("//")[1].split(".")[0]
    if code == "sc01":
        return 200, '<OAI><error code="noRecordsMatch">none</error></OAI>'
    if code == "so03":
        raise TimeoutError
    if code == "li01":
        return 200, "<OAI><ListRecords><record>cut off"
    if code == "li02":
        return 200, "<OAI><Identify/></OAI>"
    if code == "so02" and token == "b":
        return (429, "") if broken["so02"] else page(["d"], "")
    return page(["a", "b"], "b") if not token else page(["c", "a"], "")


def flaky(url, token):
    """Three pages an endpoint; the second one of so01 fails three times. Each request is noted in a file, as workers come and go."""
    code = url.split("//")[1].split(".")[0]
    note = os.environ["FAKE_OAI_NOTES"]
    with open(note, "a") as f:
        f.write(json.dumps([code, token, time.time()]) + "\n")
    with open(note) as f:
        asked = [json.loads(line)[:2] for line in f]
    if code == "so01" and token == "1" and asked.count([code, token]) <= 3:
        return 503, ""
    nth = int(token or 0)
    return page([f"{code}-{nth}", f"{code}-{nth}b", "same"], str(nth + 1) if nth < 2 else "")
