"""Small frames and a plain-Python restatement of the similarity definitions."""

from plumbline.model import ROW_ID


def frame(spark, schema: str, rows: list[tuple]):
    """Rows numbered from 0, with the given columns."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW_ID} long, {schema}")


def rows_by_issue(found):
    out = {}
    for r in found.issue_rows.collect():
        out.setdefault(r.issue_id, set()).add((r.row_id, r.role))
    return out


VENDOR_SCHEMA = (
    "vendor_id string, vendor_name string, address string, city string, state string, "
    "zip string, tax_id string, payment_terms string, ytd_spend double"
)
# The sample vendor table.
VENDORS = [
    ("V-1001", "Acme Corp.", "123 Main St", "Springfield", "IL", "62701", "47-1234567", "NET30", 142500.0),
    ("V-1002", "ACME Corporation", "123 Main Street", "Springfield", "IL", "62701", "47-1234567", "NET30", 18200.0),
    ("V-1003", "Globex Supplies", "456 Industrial Blvd", "Shelbyville", "IL", "62565", "82-9876543", "NET45", 88750.5),
]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=len)

    def best(x, y):
        n = len(x)
        windows = [y[i : i + n] for i in range(len(y) - n + 1)]
        windows += [y[:k] for k in range(1, n)] + [y[-k:] for k in range(1, n)]
        return max(ratio(x, w) for w in windows)

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    la, lb = len(both) + gap + len(left), len(both) + gap + len(right)
    score = 100 * (1 - (len(left) + len(right) - 2 * lcs(left, right)) / (la + lb))
    if not both:
        return score
    s = len(both)
    return max(score, 100 * (1 - (gap + len(left)) / (s + la)), 100 * (1 - (gap + len(right)) / (s + lb)))


def name_score(a, b):
    return max(token_set(a, b), partial(a, b))
