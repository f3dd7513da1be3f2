"""Tiny hand-made chain documents with every shape the walk has to handle."""

import json
import os


def player(company, product="", targets=(), signals=()):
    return {
        "company": company,
        "product": product,
        "connects_to": [
            {"company": t, "relationship": r, "contracts": [{"signal": s} for s in c]}
            for t, r, c in targets
        ],
        "quarterly_data": [{"quarter": q, "signal": s, "figure": f} for q, s, f in signals],
    }


ALPHA = {
    "company": "Maker", "chain_focus": "first",
    "flow": [
        {"layer": "memory", "sectors": [
            {"sector": "HBM",
             "sub_sectors": [{"sub_sector": "Stacks", "players": [
                 player("Hynix", "HBM4", [("Fab", "stacks", ["a", "b"]), ("Fab", "dies", [])])]}],
             "players": [player("Micro", "HBM3", [("Fab", "stacks", []), ("Micro", "self", [])],
                                [("Micro Q1 FY2026 (05-01-2026)", "sold", "")])]},
            {"sector": "", "players": [player("Nameless", "misc")]}]},
        {"layer": "foundry", "sectors": [
            {"sector": "Logic", "players": [
                player("Fab", "N3", [("Cloud", "wafers", ["c"]), ("Stranger", "wafers", [])])]}]},
        {"layer": "odd_slug", "sectors": [
            {"sector": "Odd", "players": [player("Oddity", "thing")]}]},
    ],
    "domains": [{"domain": "power", "sectors": [
        {"sector": "Grid", "players": [player("Volt", "transformer", [("Fab", "power", [])])]}]}],
}
BETA = {
    "company": "", "flow": [
        {"layer": "cloud_infra", "sectors": [
            {"sector": "Cloud", "players": [player("Cloud", "rent")]}]},
        {"layer": "memory", "sectors": [
            {"sector": "DRAM", "players": [
                player("Micro", "DDR5", [("Cloud", "modules", [])],
                       [("Micro Q1 FY2026 (05-01-2026)", "sold", "second"),
                        (None, "out of", "range"), (None, "out of", "again")])]}]},
        {"layer": "memory", "sectors": [
            {"sector": "HBM", "players": [player("Hynix", "HBM4E")]}]},
    ],
}


def write_chains(folder):
    os.makedirs(os.path.join(folder, "sub"), exist_ok=True)
    for name, doc in (("b_beta", BETA), ("sub/a_alpha", ALPHA)):
        with open(os.path.join(folder, name + ".json"), "w", encoding="utf-8") as f:
            json.dump(doc, f, indent=1)
    return folder
