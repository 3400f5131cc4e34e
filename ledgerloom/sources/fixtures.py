"""A small invented world with planted defects, written as the messy drop folder that a run would read."""

from __future__ import annotations

import csv
import datetime
import io
import json
import random
from dataclasses import dataclass, field
from pathlib import Path

from ledgerloom.sources.spreadsheet import write_sheets

CARRIERS = ("Northgate Mutual", "Avelin Health", "Carrow Life")
MONTHS = ("2024-01", "2024-02", "2024-03")
RATE = {"NEW": "40.00", "RENEWAL": "20.00"}
_SYLLABLES = ("ka", "lor", "min", "tes", "vo", "ral", "den", "pir", "sum", "wex", "bo", "tun")


@dataclass
class World:
    clients: list[dict] = field(default_factory=list)
    policies: list[dict] = field(default_factory=list)
    lines: list[dict] = field(default_factory=list)
    planted: list[tuple[str, str]] = field(default_factory=list)  # (kind, record key)


def clean_world(seed: int = 1, clients: int = 60) -> World:
    """Every active policy is paid its scheduled amount in every month by a line that names it right."""
    r, w = random.Random(seed), World()
    name = lambda k: "".join(r.choice(_SYLLABLES) for _ in range(k)).title()
    for i in range(clients):
        c = {"client_id": f"C{i:04}", "first_name": name(2), "last_name": f"{name(2)}{name(1).lower()}{i % 7 * 'a'}", "dob": datetime.date(1940 + i % 50, 1 + i % 12, 1 + i % 28), "zip": f"{10000 + i}", "npn": f"{3000 + i % 5}"}
        w.clients.append(c)
        carrier = CARRIERS[i % 3]
        p = {"policy_id": f"P{i:04}", "client_id": c["client_id"], "carrier": carrier, "member_id": f"M{i:05}", "lob": "MA", "effective": datetime.date(2023 if i % 2 else 2022, 6, 1), "ended": None, "status": "ACTIVE", "npn": c["npn"]}
        w.policies.append(p)
        for m in MONTHS:
            months = (int(m[:4]) - p["effective"].year) * 12 + int(m[5:]) - p["effective"].month
            kind = "NEW" if months < 12 else "RENEWAL"
            w.lines.append({"carrier": carrier, "period": m, "member_id": p["member_id"], "name": f"{c['first_name']} {c['last_name']}", "dob": c["dob"], "policy_ref": p["policy_id"], "npn": p["npn"], "amount": RATE[kind], "kind": kind})
    return w


def plant(w: World) -> World:
    """One defect of each kind, on records of its own; planted names the record each finding must point at."""
    def at(i: int) -> list[dict]:
        return [x for x in w.lines if x["policy_ref"] == f"P{i:04}"]

    w.lines.remove(at(3)[1])
    w.planted.append(("NO_PAYMENT", "P0003/2024-02"))
    at(4)[0]["amount"] = "43.21"
    w.planted.append(("AMOUNT_OFF_SCHEDULE", "P0004/2024-01"))
    w.policies[5]["status"] = "TERMINATED"
    w.planted.append(("STATUS_CONFLICT", "P0005"))
    w.lines.append(dict(at(6)[0], member_id="M99999", policy_ref="", name="Nobody, Known", dob=datetime.date(1933, 3, 3)))
    w.planted.append(("ORPHAN_PAYMENT", "M99999"))
    w.policies[7]["client_id"] = "C9999"
    w.planted.append(("MISSING_CLIENT", "C9999"))
    w.lines.append(dict(at(8)[2]))
    w.planted.append(("REPEATED_LINE", "P0008/2024-03"))
    other = w.clients[10]
    for x in at(9):
        x["name"], x["dob"] = f"{other['first_name']} {other['last_name']}", other["dob"]
    w.planted.append(("MISFILED", "P0009"))
    return w


def write_drop(w: World, folder: str) -> None:
    """crm.csv (Latin-1 with a title line and a total), a workbook per carrier, and the manifest."""
    root, files = Path(folder), []
    root.mkdir(parents=True, exist_ok=True)
    people = {c["client_id"]: c for c in w.clients}
    out = io.StringIO()
    rows = csv.writer(out, delimiter=";", lineterminator="\n")
    rows.writerow(["Book of business"] + [""] * 11)
    rows.writerow(["Client ID", "Given", "Family", "Birth Date", "Zip", "Policy #", "Company", "Member ID", "Product", "Start", "Status", "Agent #"])
    for p in w.policies:
        c = people.get(p["client_id"], {})
        dob = c.get("dob")
        rows.writerow([p["client_id"], c.get("first_name", ""), c.get("last_name", ""), dob.strftime("%m/%d/%Y") if dob else "", c.get("zip", ""), p["policy_id"], p["carrier"], p["member_id"], p["lob"], p["effective"].isoformat(), p["status"], p["npn"]])
    rows.writerow(["Total", str(len(w.policies))] + [""] * 10)
    (root / "crm.csv").write_bytes(out.getvalue().encode("latin-1"))
    files.append({"source": "crm", "file_name": "crm.csv", "rows": len(w.policies)})
    for carrier in CARRIERS:
        body = [["Period", "Subscriber #", "Member Name", "DOB", "Policy", "Agent", "Paid", "Type"]]
        body += [[x["period"], x["member_id"], x["name"], x["dob"].strftime("%d-%b-%Y"), x["policy_ref"], x["npn"], f"${x['amount']}", x["kind"]] for x in w.lines if x["carrier"] == carrier]
        name = f"statement_{carrier.lower().replace(' ', '_')}"
        (root / f"{name}.xlsx").write_bytes(write_sheets({"Lines": body}))
        files.append({"source": name, "file_name": f"{name}.xlsx", "sheet": "Lines", "rows": len(body) - 1})
    (root / "manifest.json").write_text(json.dumps({"seed": 1, "files": files}))
