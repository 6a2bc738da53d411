"""DuckDB SQL for the oracles, written from the definitions rather than from the Spark plans.

Everything is plain text: unsigned 64-bit arithmetic goes through UHUGEINT modulo 2**64,
registers are a GROUP BY, estimates follow the published formulas literally.
"""

from __future__ import annotations

import json
import subprocess
import sys

MOD = "18446744073709551616::UHUGEINT"
MASK = (1 << 64) - 1

# Fixed values of the published hash functions.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
P1, P2, P3, P4, P5 = (
    11400714785074694791, 14029467366897019727, 1609587929392839161,
    9650029242287828579, 2870177450012600261,
)
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
F1, F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
K0, K1 = 0x0706050403020100, 0x0F0E0D0C0B0A0908
SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
THRESHOLDS = [
    10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000,
]


def u(value: int) -> str:
    return f"{value & MASK}::UBIGINT"


def add(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {MOD})::UBIGINT"


def mul(a: str, c: int) -> str:
    return f"((({a})::UHUGEINT * {c & MASK}::UHUGEINT) % {MOD})::UBIGINT"


def rotl(a: str, n: int) -> str:
    high = f"((({a})::UHUGEINT * {1 << n}::UHUGEINT) % {MOD})::UBIGINT"
    return f"({high} | (({a}) >> {64 - n}))"


def xshift(a: str, n: int) -> str:
    return f"xor({a}, ({a}) >> {n})"


class Steps:
    """Nested subqueries, one intermediate column each."""

    def __init__(self, source: str):
        self.text = source
        self.count = 0

    def let(self, expression: str) -> str:
        self.count += 1
        name = f"z{self.count}"
        self.text = f"(SELECT *, {expression} AS {name} FROM {self.text})"
        return name


def hashed(source: str, keep: str, value: str, name: str = "splitmix64", seed: int = 0) -> str:
    """Subquery with ``keep`` columns, ``v`` and the unsigned hash ``h``."""
    base = f"(SELECT {keep + ', ' if keep else ''}({value})::BIGINT AS v FROM {source} WHERE ({value}) IS NOT NULL)"
    s = Steps(f"(SELECT *, v::UBIGINT AS z0 FROM {base})")
    x = "z0"
    if name == "splitmix64":
        x = s.let(add(x, u(GAMMA)))
        x = s.let(mul(xshift(x, 30), MIX1))
        x = s.let(mul(xshift(x, 27), MIX2))
        x = s.let(xshift(x, 31))
    elif name == "xxhash64":
        x = s.let(mul(x, P2))
        x = s.let(mul(rotl(x, 31), P1))
        x = s.let(f"xor({x}, {u(seed + P5 + 8)})")
        x = s.let(mul(rotl(x, 27), P1))
        x = s.let(add(x, u(P4)))
        x = s.let(mul(xshift(x, 33), P2))
        x = s.let(mul(xshift(x, 29), P3))
        x = s.let(xshift(x, 32))
    elif name == "murmurhash3":
        x = s.let(mul(x, C1))
        x = s.let(mul(rotl(x, 31), C2))
        x = s.let(f"xor({x}, {u(seed)})")
        x = s.let(add(rotl(x, 27), u(seed)))
        x = s.let(mul(x, 5))
        x = s.let(add(x, u(0x52DCE729)))
        a = s.let(add(f"xor({x}, {u(8)})", u(seed ^ 8)))
        b = s.let(add(a, u(seed ^ 8)))
        out = []
        for y in (a, b):
            y = s.let(mul(xshift(y, 33), F1))
            y = s.let(mul(xshift(y, 33), F2))
            out.append(s.let(xshift(y, 33)))
        x = s.let(add(*out))
    elif name == "siphash24":
        v = [u(SIP[i] ^ (K0, K1)[i % 2]) for i in range(4)]

        def rounds(n: int) -> None:
            for _ in range(n):
                v[0] = s.let(add(v[0], v[1]))
                v[1] = s.let(f"xor({rotl(v[1], 13)}, {v[0]})")
                v[0] = s.let(rotl(v[0], 32))
                v[2] = s.let(add(v[2], v[3]))
                v[3] = s.let(f"xor({rotl(v[3], 16)}, {v[2]})")
                v[0] = s.let(add(v[0], v[3]))
                v[3] = s.let(f"xor({rotl(v[3], 21)}, {v[0]})")
                v[2] = s.let(add(v[2], v[1]))
                v[1] = s.let(f"xor({rotl(v[1], 17)}, {v[2]})")
                v[2] = s.let(rotl(v[2], 32))

        for block in (x, u(8 << 56)):
            v[3] = s.let(f"xor({v[3]}, {block})")
            rounds(2)
            v[0] = s.let(f"xor({v[0]}, {block})")
        v[2] = s.let(f"xor({v[2]}, {u(255)})")
        rounds(4)
        x = s.let(f"xor(xor({v[0]}, {v[1]}), xor({v[2]}, {v[3]}))")
    else:
        raise ValueError(name)
    names = "".join(part.split(" AS ")[-1].strip() + ", " for part in keep.split(",") if part)
    return f"(SELECT {names}v, {x} AS h FROM {s.text})"


def signed(h: str = "h") -> str:
    return (
        f"(CASE WHEN {h} >= 9223372036854775808::UBIGINT "
        f"THEN ({h}::HUGEINT - 18446744073709551616::HUGEINT) ELSE {h}::HUGEINT END)::BIGINT"
    )


def rank(h: str, k: int, width: int = 64) -> str:
    """One plus the leading zeros of what follows the top k bits of a ``width``-bit word."""
    word = h if width == 64 else f"({h} >> {64 - width})"
    rest = f"({word} & {u((1 << (width - k)) - 1)})"
    return (
        f"(CASE WHEN {rest} = 0 THEN {width - k + 1} "
        f"ELSE {width - k} - length(bin({rest})) + 1 END)::INT"
    )


def index(h: str, k: int) -> str:
    return f"({h} >> {64 - k})::INT"


def cols(keys: list[str]) -> str:
    return ", ".join(keys)


def lead(keys: list[str]) -> str:
    return "".join(k + ", " for k in keys)


def group(keys: list[str]) -> str:
    return f"GROUP BY {cols(keys)}" if keys else ""


def registers(hashes: str, keys: list[str], k: int, width: int = 64) -> str:
    return (
        f"(SELECT {lead(keys)}{index('h', k)} AS idx, max({rank('h', k, width)})::INT AS rho "
        f"FROM {hashes} GROUP BY ALL)"
    )


def alpha(k: int) -> float:
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(k, 0.7213 / (1 + 1.079 / (1 << k)))


def loglog(regs: str, keys: list[str], k: int) -> str:
    m = 1 << k
    return (
        f"(SELECT {lead(keys)}floor(0.39701::DOUBLE * {m} * pow(2.0::DOUBLE, sum(rho) / {m}::DOUBLE))"
        f"::BIGINT AS estimate FROM {regs} {group(keys)})"
    )


def _sums(regs: str, keys: list[str], k: int) -> str:
    m = 1 << k
    return (
        f"(SELECT {lead(keys)}count(*) AS occ, {alpha(k)!r}::DOUBLE * {m}::DOUBLE * {m}::DOUBLE / "
        f"(sum(pow(2.0::DOUBLE, -rho)) + ({m} - count(*))) AS raw FROM {regs} {group(keys)})"
    )


def hyperloglog(regs: str, keys: list[str], k: int) -> str:
    m = 1 << k
    return (
        f"(SELECT {lead(keys)}floor(CASE "
        f"WHEN raw <= 2.5 * {m} AND occ < {m} THEN {m} * ln({m}::DOUBLE / ({m} - occ)) "
        f"WHEN raw <= 4294967296.0 / 30 THEN raw "
        f"ELSE -4294967296.0 * ln(1 - raw / 4294967296.0) END)::BIGINT AS estimate "
        f"FROM {_sums(regs, keys, k)})"
    )


_points: dict[int, list] = {}


def bias_points() -> dict[int, list]:
    """The published points, from the running session or from a session of its own."""
    if not _points:
        from pyspark.sql import SparkSession

        from tallymark.functions.bias import published_bias_points

        session = SparkSession.getActiveSession()
        if session is not None:
            _points.update(published_bias_points(session))
        else:
            # A separate process, so that the caller's own session is not started early.
            code = (
                "import json\n"
                "from pyspark.sql import SparkSession\n"
                "from tallymark.functions.bias import published_bias_points\n"
                "s = SparkSession.builder.master('local[1]')"
                ".config('spark.ui.enabled', 'false').getOrCreate()\n"
                "print('POINTS' + json.dumps(published_bias_points(s)))\n"
                "s.stop()\n"
            )
            import os

            root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
            run = subprocess.run(
                [sys.executable, "-c", code], cwd=root, capture_output=True, text=True,
                timeout=120, check=True,
            )
            line = next(x for x in run.stdout.splitlines() if x.startswith("POINTS"))
            _points.update({int(k): v for k, v in json.loads(line[6:]).items()})
    return _points


def corrected(regs: str, keys: list[str], k: int) -> str:
    """Subquery with occ, raw, mean bias of the six nearest points and corrected estimate."""
    m = 1 << k
    points = ", ".join(
        f"({i}, {r!r}::DOUBLE, {b!r}::DOUBLE)" for i, (r, b) in enumerate(bias_points()[k])
    )
    return (
        f"(WITH s AS (SELECT *, row_number() OVER () AS rid FROM {_sums(regs, keys, k)}), "
        f"p(ord, r, b) AS (VALUES {points}), "
        f"n AS (SELECT rid, avg(b) AS bias FROM (SELECT s.rid, p.b, row_number() OVER "
        f"(PARTITION BY s.rid ORDER BY abs(p.r - s.raw), p.ord) AS near FROM s, p) "
        f"WHERE near <= 6 GROUP BY rid) "
        f"SELECT {''.join('s.' + key + ', ' for key in keys)}s.occ, s.raw, n.bias, "
        f"CASE WHEN s.raw <= 5.0 * {m} THEN greatest(s.raw - n.bias, 0.0) ELSE s.raw END "
        f"AS corrected FROM s JOIN n ON s.rid = n.rid)"
    )


def hllpp_dense(regs: str, keys: list[str], k: int) -> str:
    m = 1 << k
    linear = (
        f"(CASE WHEN occ < {m} THEN {m} * ln({m}::DOUBLE / ({m} - occ)) ELSE corrected END)"
    )
    return (
        f"(SELECT {lead(keys)}floor(CASE WHEN {linear} <= {THRESHOLDS[k - 4]} THEN {linear} "
        f"ELSE corrected END)::BIGINT AS estimate FROM {corrected(regs, keys, k)})"
    )


def hllpp_sparse(codes: str, keys: list[str]) -> str:
    """``codes`` holds keys and idx, rho at precision 25."""
    return (
        f"(SELECT {lead(keys)}floor(33554432::DOUBLE * ln(33554432::DOUBLE / "
        f"(33554432 - count(*))))::BIGINT AS estimate FROM {codes} {group(keys)})"
    )


def list_bits(codes: str, keys: list[str], k: int) -> str:
    """Keys, number of codes and size of the delta-coded list."""
    low = (1 << (25 - k)) - 1
    entry = (
        f"(idx::BIGINT * 128 + CASE WHEN (idx & {low}) = 0 THEN rho * 2 + 1 ELSE 0 END)"
    )
    part = f"PARTITION BY {cols(keys)} " if keys else ""
    return (
        f"(SELECT {lead(keys)}count(*)::BIGINT AS n_codes, "
        f"sum(8 * greatest(1, (length(bin(delta)) + 6) // 7))::BIGINT AS list_bits FROM "
        f"(SELECT {lead(keys)}e - lag(e, 1, 0::BIGINT) OVER ({part}ORDER BY e) AS delta FROM "
        f"(SELECT {lead(keys)}{entry} AS e FROM {codes})) {group(keys)})"
    )


def hllpp_auto(hashes: str, keys: list[str], k: int) -> str:
    codes = registers(hashes, keys, 25)
    dense = hllpp_dense(registers(hashes, keys, k), keys, k)
    sparse = hllpp_sparse(codes, keys)
    sizes = list_bits(codes, keys, k)
    on = " AND ".join([f"a.{x} IS NOT DISTINCT FROM z.{x}" for x in keys]) or "true"
    on2 = on.replace("a.", "b.")
    return (
        f"(SELECT {''.join('z.' + x + ', ' for x in keys)}CASE WHEN z.n_codes >= 4096 AND "
        f"z.list_bits > {6 << k} THEN a.estimate ELSE b.estimate END AS estimate "
        f"FROM {sizes} z JOIN {dense} a ON {on} JOIN {sparse} b ON {on2})"
    )


def pc_bitmap(hashes: str, keys: list[str], length: int = 31) -> str:
    x = f"((h >> 32) & {u((1 << length) - 1)})"
    low = f"(length(bin({x})) - length(rtrim(bin({x}), '0')))"
    return (
        f"(SELECT {lead(keys)}bit_or(CASE WHEN {x} = 0 THEN 0::BIGINT ELSE "
        f"(1::BIGINT << {low}::INT) END) AS bitmap FROM {hashes} {group(keys)})"
    )


def probabilistic(hashes: str, keys: list[str], length: int) -> str:
    ones = f"least({length}, strpos(reverse(bin(bitmap)) || '0', '0') - 1)"
    return (
        f"(SELECT {lead(keys)}floor(pow(2.0::DOUBLE, {ones}) / 0.77351::DOUBLE)::BIGINT AS estimate "
        f"FROM {pc_bitmap(hashes, keys, length)})"
    )


def estimate(algo: str, hashes: str, keys: list[str], k: int | None, length: int | None = None) -> str:
    """Keys and estimate of one dense sketch per key."""
    if algo == "pc":
        return probabilistic(hashes, keys, length)
    if algo == "hllpp":
        return hllpp_dense(registers(hashes, keys, k), keys, k)
    regs = registers(hashes, keys, k, 32)
    return (loglog if algo == "ll" else hyperloglog)(regs, keys, k)


def reduce(regs: str, keys: list[str], k: int, to: int, naive: bool = False) -> str:
    """Registers lowered from precision k to ``to``."""
    drop = k - to
    if not drop:
        return regs
    suffix = f"(idx & {(1 << drop) - 1})"
    rho = "rho" if naive else (
        f"CASE WHEN {suffix} = 0 THEN rho + {drop} ELSE {drop} - length(bin({suffix})) + 1 END"
    )
    return (
        f"(SELECT {lead(keys)}(idx >> {drop})::INT AS idx, max({rho})::INT AS rho "
        f"FROM {regs} GROUP BY ALL)"
    )


def plan_points(n: str, budget: int) -> str:
    """Subquery ``(i, t)``: the checkpoint plan of a stream of n elements, for any n.

    ``n`` is a scalar subquery, ``budget`` at least 2.
    """
    last = budget - 1
    spare = f"(n - {budget})::HUGEINT"
    early = f"{spare} * pow(2 * i, 4)::HUGEINT // {10 * last**4}"
    late = f"{spare} * ({last} + 9 * (2 * i - {last})) // {10 * last}"
    return (
        f"(SELECT i, (CASE WHEN n <= {budget} THEN 1 + i WHEN 2 * i <= {last} "
        f"THEN 1 + i + {early} ELSE 1 + i + {late} END)::BIGINT AS t "
        f"FROM (SELECT {n} AS n) s, range({budget}) r(i) WHERE i < n)"
    )
