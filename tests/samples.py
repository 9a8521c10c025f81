"""A small review run of made-up figures: six seeded bugs, all found and fixed, ten tests."""

import json

from reviewlake.schemas import RECORDED

LINES = [3, 8, 14, 19, 27, 32]
SEVERITY = ["Medium", "Low", "High", "Medium", "Low", "Medium"]
TYPES = ["Security", "Performance", "Logical", "Runtime", "Syntax", "Performance"]
TAGS = ["E1", "E2", "E3", "E3", "E4", "E5", "E5", "E6", None, "E2"]


def original() -> str:
    """40 lines and a final newline."""
    return "".join(f"line {n}\n" for n in range(1, 41))


def fixed() -> str:
    """Four changed lines and one new line in front of line 18."""
    out = []
    for n in range(1, 41):
        if n == 18:
            out.append("guard\n")
        out.append(f"fixed {n}\n" if n in (3, 14, 27, 32) else f"line {n}\n")
    return "".join(out)


def issue(n: int) -> dict:
    return {
        "id": f"E{n + 1}",
        "type": TYPES[n],
        "description": f'bug "{n}" → here',
        "line": LINES[n],
        "severity": SEVERITY[n],
        "suggestion": "change it",
    }


def analysis() -> dict:
    return {"errors": [issue(n) for n in range(len(LINES))], "risk_level": "High", "summary": "six findings"}


def fixes() -> list:
    return [{"issueId": f"E{n}", "change": f"changed {n}"} for n in range(1, len(LINES) + 1)]


def titles() -> list[str]:
    return [f"[{t}] case {i}" if t else f"edge {i}" for i, t in enumerate(TAGS)]


def test_code() -> str:
    cases = "".join(f"  it('{t}', () => {{}});\r\n" for t in titles())
    return f"describe('all', () => {{\r\n{cases}}});\r\n"


def summary() -> dict:
    words = [30, 20, 19, 22]
    return {"summary": "done", "recommendations": [" ".join(["word"] * n) for n in words]}


def truth() -> dict:
    return {"bugs": [{"id": f"bug-{n}", "line": n, "description": "seeded"} for n in LINES]}


def meta(name: str = "cart", ext: str = ".ts") -> dict:
    return {
        "name": name,
        "fileName": f"samples/{name}{ext}",
        "language": "typescript" if ext == ".ts" else "javascript",
        "ext": ext,
        "startedAt": "2031-04-05T06:07:08.250Z",
    }


def result(passed: int, failed: int, total: int) -> dict:
    return {"numPassedTests": passed, "numFailedTests": failed, "numTotalTests": total, "testResults": [{"x": 1}]}


def report() -> dict:
    return {
        "schemaVersion": 1,
        "id": "cart",
        "title": "cart",
        "fileName": "samples/cart.ts",
        "language": "typescript",
        "source": {"kind": RECORDED, "model": "m", "recordedAt": "2031-04-05T06:07:08.348Z", "author": "someone"},
        "originalCode": original(),
        "analysis": analysis(),
        "fix": {"fixedCode": fixed().replace("\n", "\r\n"), "fixes": fixes()},
        "tests": {
            "framework": "vitest",
            "code": test_code(),
            "cases": [{"name": n, "issueId": t} for n, t in zip(titles(), TAGS)],
        },
        "report": summary(),
        "verification": {
            "command": "npx vitest run",
            "original": {"passed": 2, "failed": 8, "total": 10},
            "fixed": {"passed": 10, "failed": 0, "total": 10},
        },
        "detection": {"expected": 6, "caught": 6, "missed": []},
    }


def write_run(folder, name: str = "cart", ext: str = ".ts", **replace) -> None:
    """A run folder; ``replace`` maps a file name (dots as __) to other text, None to leave it out."""
    files = {
        "meta.json": json.dumps(meta(name, ext)),
        f"original{ext}": original(),
        "analysis.json": json.dumps(analysis()),
        f"fixed{ext}": fixed(),
        "fixes.json": json.dumps(fixes()),
        "cart.test.ts": test_code(),
        "report.json": json.dumps(summary()),
        "vitest-original.json": json.dumps(result(2, 8, 10)),
        "vitest-fixed.json": json.dumps(result(10, 0, 10)),
    }
    files.update({k.replace("__", "."): v for k, v in replace.items()})
    target = folder / name
    target.mkdir(parents=True)
    for file, text in files.items():
        if text is not None:
            (target / file).write_bytes(text.encode())
