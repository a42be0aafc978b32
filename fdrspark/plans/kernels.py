"""Forward selectors in which real columns race against null columns that are drawn along a growing basis.

All arrays are local to one task. X has columns that are centred and of unit
length; y is centred. Null column d of experiment k has, along basis vector m, a
coordinate that depends on (seed, k, d, m) alone, so a task that is run again
draws the same.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from fdrspark.functions.rng import normals, sphere_coordinates

REAL, DUMMY = "real", "dummy"


class Columns:
    """Columns (or rows) that are appended one by one to an array with room to spare."""

    def __init__(self, length: int, by_rows: bool = False):
        self.by_rows, self.count = by_rows, 0
        self.data = np.empty((8, length))

    def append(self, v: np.ndarray) -> None:
        if self.count == len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.count] = v
        self.count += 1

    @property
    def view(self) -> np.ndarray:
        rows = self.data[: self.count]
        return rows if self.by_rows else rows.T


@dataclass
class Race:
    """State that all selectors share: active columns, the basis, and the pool of null columns."""

    x: np.ndarray
    y: np.ndarray
    n_dummies: int
    seed: int = 0
    experiment: int = 0
    law: str = "spherical"
    eps: float = 1e-12
    max_basis: int | None = None
    given: np.ndarray | None = None  # explicit null columns, in place of a pool
    hook: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None  # (y, fit) -> score, in place of the residual
    status: str = "running"
    entries: list[tuple[str, int, int]] = field(default_factory=list)  # kind, index, dummies before
    path: list[dict[int, float]] = field(default_factory=list)

    def __post_init__(self):
        if self.law not in ("spherical", "gaussian"):
            raise ValueError(f"law {self.law!r} is neither spherical nor gaussian")
        if self.x.ndim != 2 or len(self.x) != len(self.y):
            raise ValueError("X and y disagree in rows")
        self.n, self.p = self.x.shape
        self.cap = min(self.n - 1, self.max_basis or max(32, self.n))
        self._basis, self._coords = Columns(self.n), Columns(self.n_dummies, by_rows=True)
        self._active, self._span = Columns(self.n), Columns(self.n)
        self.stick = np.ones(self.n_dummies)
        self.open = np.ones(self.n_dummies, bool)  # not yet made
        self.gram = np.zeros((0, 0))  # of the active columns
        self.is_real = np.zeros(self.p, bool)
        self.made: list[int] = []
        self.fit = np.zeros(self.n)
        self.residual = self.y.astype(float).copy()
        self.coef = np.zeros(0)
        self.path.append({})
        if np.linalg.norm(self.y) <= self.eps:
            self.status = "constant response"
        else:
            self.grow(self.start_direction())

    basis = property(lambda self: self._basis.view)
    coords = property(lambda self: self._coords.view)
    active = property(lambda self: self._active.view)
    span = property(lambda self: self._span.view, doc="of the active columns, orthonormal")

    def start_direction(self) -> np.ndarray:
        return self.y

    def save(self) -> bytes:
        """All of the state but X, y and given null columns, which whoever loads it has."""
        return pickle.dumps({k: v for k, v in self.__dict__.items() if k not in ("x", "y", "given")}, protocol=5)

    @classmethod
    def load(cls, blob: bytes, x: np.ndarray, y: np.ndarray, given: np.ndarray | None = None) -> Race:
        """The race that was saved, to be run on; an error if X has another shape than it had."""
        state = pickle.loads(blob)
        if np.shape(x) != (state["n"], state["p"]) or len(y) != state["n"]:
            raise ValueError(f"the saved race has {state['n']} x {state['p']}, not {np.shape(x)}")
        race = cls.__new__(cls)
        race.__dict__.update(state, x=np.asarray(x, float), y=np.asarray(y, float), given=given)
        return race

    @property
    def n_made(self) -> int:
        return len(self.made)

    def direction_left(self, v: np.ndarray) -> np.ndarray | None:
        """v without its part in the basis, of unit length; projected twice, so that it stays orthogonal."""
        size = np.linalg.norm(v)
        w = v - self.basis @ (self.basis.T @ v)
        w -= self.basis @ (self.basis.T @ w)
        left = np.linalg.norm(w)
        return w / left if left > 1e-10 * max(size, 1e-300) else None

    def grow(self, v: np.ndarray) -> bool:
        """Take v's new direction into the basis and draw the pool's coordinates along it."""
        w = self.direction_left(v)
        if w is None or self.basis.shape[1] >= self.cap:
            return False
        m = self.basis.shape[1]
        self._basis.append(w)
        if self.given is not None:
            a = self.given.T @ w
        else:
            a = np.zeros(self.n_dummies)
            live = np.flatnonzero(self.open & (self.stick > self.eps))
            key = (self.seed, self.experiment, m)
            if self.law == "gaussian":
                a[live] = normals(key, live) / np.sqrt(self.n)
            elif self.n - m - 2 > 0:
                a[live] = np.sqrt(self.stick[live]) * sphere_coordinates(self.n - m - 2, key, live)
                self.stick[live] = np.maximum(self.stick[live] - a[live] ** 2, 0)
        self._coords.append(a)
        return True

    def pool_products(self, v: np.ndarray) -> np.ndarray:
        """Products of the pool with a vector in the basis' span."""
        if self.given is not None:
            return self.given.T @ v
        return self.coords.T @ (self.basis.T @ v)

    def make(self, d: int) -> np.ndarray:
        """Null column d in full: its coordinates, and what is left of its length in a random direction outside the basis."""
        if self.given is not None:
            return self.given[:, d]
        z = normals((self.seed, self.experiment, -1 - d), np.arange(self.n))
        z -= z.mean()
        z -= self.basis @ (self.basis.T @ z)
        if self.law == "spherical":
            z *= np.sqrt(self.stick[d]) / max(np.linalg.norm(z), 1e-300)
        else:
            z /= np.sqrt(self.n)
        return self.basis @ self.coords[:, d] + z

    def widen(self, column: np.ndarray) -> bool:
        """Take a column into the span of the active ones; False if it lies there already."""
        q = column - self.span @ (self.span.T @ column)
        q -= self.span @ (self.span.T @ q)
        size = np.linalg.norm(q)
        if size < 1e-8:
            return False
        self._span.append(q / size)
        return True

    def enter(self, kind: str, index: int, sign: float = 1.0) -> bool:
        """Make a column active; False if it lies in the span of the active ones, in which case it is passed over for good."""
        column = self.x[:, index] if kind == REAL else self.make(index)
        if kind == REAL:
            self.is_real[index] = True
        if not self.widen(column):
            return False
        before = self.n_made
        if kind == DUMMY:
            self.open[index] = False
            self.made.append(index)
        self.entries.append((kind, index, before))
        self.append_active(sign * column)
        self.coef = np.append(self.coef, 0.0)
        self.after_entry(column)
        if kind == DUMMY:
            self.stick[index] = 0.0
        return True

    def append_active(self, column: np.ndarray) -> None:
        shared = self.active.T @ column
        self._active.append(column)
        self.gram = np.block([[self.gram, shared[:, None]], [shared[None, :], np.array([[column @ column]])]])

    def after_entry(self, column: np.ndarray) -> None:
        if not self.grow(column) and self.basis.shape[1] >= self.cap:
            self.status = "pool exhausted"

    def score(self) -> np.ndarray:
        """The direction along which columns compete; a hook's is taken into the basis, centred, so that the pool sees all of it."""
        if self.hook is None:
            return self.residual
        s = self.hook(self.y, self.fit)
        s = s - s.mean()
        self.grow(s)
        return s

    def record(self) -> None:
        signs = self.signs()
        self.path.append({i: float(b * s) for (kind, i, _), b, s in zip(self.entries, self.coef, signs, strict=True) if kind == REAL})

    def signs(self) -> np.ndarray:
        return np.ones(len(self.entries))

    def leader(self) -> tuple[str, int, float] | None:
        """The column of greatest product with the score; ties go to null columns, then to the least index."""
        s = self.score()
        real = np.where(self.is_real, -1.0, np.abs(self.x.T @ s))
        null = np.where(self.open, np.abs(self.pool_products(s)), -1.0) if self.n_dummies else np.array([-1.0])
        j, d = int(real.argmax()), int(null.argmax())
        if max(real[j], null[d]) < 100 * self.eps:
            return None
        return (DUMMY, d, float(null[d])) if null[d] >= real[j] else (REAL, j, float(real[j]))

    def limit(self, t: int) -> int:
        return min(self.n - 1, self.p) + self.n_dummies if t < 0 else self.p + self.n_dummies

    def run(self, t: int, max_steps: int | None = None) -> Race:
        """Go on until t null columns are active, nothing is left to enter, or after max_steps; at once if that holds already."""
        steps = 0
        while self.status == "running" and self.n_made < t and (max_steps is None or steps < max_steps):
            if self.active.shape[1] >= min(self.n - 1, self.p + self.n_dummies):
                self.status = "saturated"
            elif not self.step():
                self.status = "done" if self.status == "running" else self.status
            else:
                self.record()
            steps += 1
        return self

    def step(self) -> bool:
        raise NotImplementedError


class LeastAngle(Race):
    """Least angle regression: all active columns keep equal products with the residual, which fall together."""

    tol = 1e-10
    #: Steps after which the products with the residual, which are carried on from step to step, are taken anew.
    refresh = 64

    def __post_init__(self):
        self.sign, self.steps = np.zeros(0), 0
        super().__post_init__()

    def products(self) -> None:
        self.c = self.x.T @ self.residual
        self.null = self.pool_products(self.residual)

    def signs(self) -> np.ndarray:
        return self.sign

    def _join(self, kind: str, index: int, product: float) -> bool:
        sign = 1.0 if product >= 0 else -1.0
        if not self.enter(kind, index, sign):
            return False
        self.sign = np.append(self.sign, sign)
        return True

    def step(self) -> bool:
        if self.steps % self.refresh == 0:
            self.products()
        self.steps += 1
        # The residual lies in the basis, so that a pool drawn along new directions keeps its products with it.
        r, c, null = self.residual, self.c, np.where(self.open, self.null, 0.0)
        top = np.abs(self.active.T @ r).max(initial=0.0)
        if not len(self.entries):
            first = self.leader()
            if first is None:
                return False
            if first[0] == DUMMY:
                self._join(DUMMY, first[1], null[first[1]])
                top = abs(null[first[1]])
            else:
                top = np.abs(c).max()
        if top < 100 * self.eps:
            return False
        for j in np.flatnonzero(~self.is_real & (np.abs(c) >= top - 1e-9 * max(1.0, top))):
            self._join(REAL, int(j), c[j])
        if not len(self.entries):
            return False
        w = np.linalg.solve(self.gram, np.ones(len(self.gram)))
        a_top = 1 / np.sqrt(max(w.sum(), 1e-300))
        w *= a_top
        u = self.active @ w
        a, a_null = self.x.T @ u, self.pool_products(u)
        gamma, j = self._least(c, a, ~self.is_real, top, a_top)
        null = np.where(self.open, self.null, 0.0)
        gamma_null, d = self._least(null, a_null, self.open, top, a_top)
        full = top / a_top
        move = min(gamma, gamma_null, full)
        self.fit = self.fit + move * u
        self.coef = self.coef + move * w
        self.residual = self.y - self.fit
        self.c = c - move * a
        self.null = self.null - move * a_null
        if gamma_null < gamma + self.tol and gamma_null <= full:
            self._join(DUMMY, d, float(null[d] - move * a_null[d]))
            return True
        return move < full

    def _least(self, c, a, allowed, top, a_top) -> tuple[float, int]:
        best, at = np.inf, -1
        for num, den in ((top - c, a_top - a), (top + c, a_top + a)):
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(allowed & (np.abs(den) > self.tol), num / den, np.inf)
            t[~(t > self.tol)] = np.inf
            if len(t):
                i = int(t.argmin())
                if t[i] < best or (t[i] == best and i < at):
                    best, at = float(t[i]), i
        return best, at


class MatchingPursuit(Race):
    """Orthogonal matching pursuit: the leader enters, then least squares on all that are active."""

    def step(self) -> bool:
        lead = self.leader()
        if lead is None:
            return False
        if self.enter(lead[0], lead[1]):
            self.coef = np.linalg.lstsq(self.active, self.y, rcond=None)[0]
            self.fit = self.active @ self.coef
            self.residual = self.y - self.fit
        elif lead[0] == DUMMY:
            return False
        return True


@dataclass
class Adaptive(Race):
    """Adaptive forward selection: after each choice the fit goes a share rho of the way to least squares.

    An active column may lead again, which takes the fit a share further.
    """

    rho: float = 1.0

    def __post_init__(self):
        self.rho = min(max(self.rho, 1e-6), 1.0)
        super().__post_init__()

    def target(self) -> np.ndarray:
        return np.linalg.lstsq(self.active, self.y, rcond=None)[0]

    def update(self, goal: np.ndarray) -> None:
        self.coef = (1 - self.rho) * self.coef + self.rho * goal
        self.fit = self.active @ self.coef
        self.residual = self.y - self.fit

    def step(self) -> bool:
        s = self.score()
        lead = self.leader()
        held = np.abs(self.active.T @ s)
        strongest = held.max(initial=0.0)
        if max(lead[2] if lead else 0.0, strongest) < 100 * self.eps:
            return False
        # A real column that is active takes part as itself; null columns come first in ties.
        again = lead is None or strongest > lead[2] or (strongest == lead[2] and lead[0] == REAL)
        if not again and not self.enter(lead[0], lead[1]) and lead[0] == DUMMY:
            return False
        self.update(self.target())
        return True


class AdaptiveLogistic(Adaptive):
    """The same for a 0/1 response: the score is y - P(1), targets come from Newton steps, no intercept."""

    def __post_init__(self):
        self.labels = (self.y > 0).astype(float)
        super().__post_init__()
        self.residual = self.score()

    def score(self) -> np.ndarray:
        return self.labels - 1 / (1 + np.exp(-np.clip(self.fit, -500, 500)))

    def target(self) -> np.ndarray:
        b = self.coef.copy()
        for _ in range(25):
            pr = np.clip(1 / (1 + np.exp(-np.clip(self.active @ b, -500, 500))), 1e-10, 1 - 1e-10)
            h = (self.active * (pr * (1 - pr))[:, None]).T @ self.active + 1e-8 * np.eye(len(b))
            step = np.linalg.solve(h, self.active.T @ (self.labels - pr))
            step *= min(1.0, 10 / max(np.abs(step).max(), 1e-300))
            b = b + step
            if step @ step < 1e-8:
                break
        return b

    def update(self, goal: np.ndarray) -> None:
        self.coef = (1 - self.rho) * self.coef + self.rho * goal
        self.fit = self.active @ self.coef
        self.residual = self.score()
        self.grow(self.residual - self.residual.mean())  # null columns are centred, so their products see no more


SOLVERS = {"lars": LeastAngle, "omp": MatchingPursuit, "afs": Adaptive, "afs_logistic": AdaptiveLogistic}


def make(solver: str, x, y, n_dummies, rho: float = 1.0, **options) -> Race:
    if solver not in SOLVERS:
        raise ValueError(f"solver {solver!r} is none of {sorted(SOLVERS)}")
    if solver.startswith("afs"):
        options["rho"] = rho
    if options.get("hook") and solver in ("lars", "afs_logistic"):
        raise ValueError(f"{solver} has a score of its own")
    return SOLVERS[solver](np.asarray(x, float), np.asarray(y, float), n_dummies, **options)


def state_of(race: Race) -> dict:
    """What the accessors of a finished or paused race show."""
    s = race.score()
    return {
        "status": race.status, "n_samples": race.n, "n_features": race.p, "num_dummies": race.n_dummies, "num_realized": race.n_made,
        "basis_size": race.basis.shape[1], "corr_real": race.x.T @ s, "corr_pool": np.where(race.open, race.pool_products(s), 0.0), "stick": race.stick,
        "coords": race.coords, "entries": list(race.entries), "beta": race.path[-1],
    }


def explicit_null(n: int, count: int, law: str, seed: int) -> np.ndarray:
    """count null columns in full, centred and of unit length, of one of six laws."""
    from fdrspark.functions.rng import units

    i = np.arange(n * count)
    u = units((seed, 77), i)
    z = normals((seed, 78), i)
    draw = {
        "gaussian": lambda: z,
        "rademacher": lambda: np.where(u < 0.5, -1.0, 1.0),
        "exponential": lambda: -np.log(u),
        "t": lambda: z / np.sqrt(sum(normals((seed, 80 + k), i) ** 2 for k in range(3)) / 3),
        "lognormal": lambda: np.exp(z),
        "pareto": lambda: u ** (-1 / 3),
    }
    if law not in draw:
        raise ValueError(f"law {law!r} is none of {sorted(draw)}")
    d = draw[law]().reshape(n, count)
    d = d - d.mean(0)
    return d / np.maximum(np.linalg.norm(d, axis=0), 1e-12)
