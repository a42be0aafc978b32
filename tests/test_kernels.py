import numpy as np
import pytest

from fdrspark.functions import tails
from fdrspark.functions.rng import normals, sphere_coordinates, units
from fdrspark.plans import kernels, rivals, studies


def problem(n=120, p=60, seed=0):
    x, y, true = studies.problem(seed, 0, n, p, 4, 5.0)
    return x, y, true


def test_units_depend_on_their_key_alone():
    a = units((1, 2), np.arange(10))
    assert np.array_equal(a[3:6], units((1, 2), np.arange(3, 6)))
    assert not np.array_equal(a, units((1, 3), np.arange(10)))
    z = normals((4,), np.arange(40_000))
    assert abs(z.mean()) < 0.02 and abs(z.var() - 1) < 0.03


@pytest.mark.parametrize("nu", [4, 18])
def test_sphere_coordinates_have_beta_squares(nu):
    b = sphere_coordinates(nu, (7, nu), np.arange(60_000))
    assert abs((b * b).mean() - 1 / (nu + 1)) < 0.01


@pytest.mark.parametrize("solver", sorted(kernels.SOLVERS))
def test_basis_and_pool_keep_their_lengths(solver):
    x, y, _ = problem()
    r = kernels.make(solver, x, y, 200, rho=0.5, seed=1).run(3)
    assert r.n_made == 3
    assert np.abs(r.basis.T @ r.basis - np.eye(r.basis.shape[1])).max() < 1e-10
    whole = r.stick + (r.coords**2).sum(0)
    assert np.abs(whole[r.open] - 1).max() < 1e-10
    for i, (kind, _, _) in enumerate(r.entries):
        if kind == kernels.DUMMY:
            assert abs(np.linalg.norm(r.active[:, i]) - 1) < 1e-8 and abs(r.active[:, i].sum()) < 1e-8


def test_least_angle_products_are_equal_at_every_knot():
    x, y, _ = problem()
    r = kernels.make("lars", x, y, 100, seed=2)
    for _ in range(8):
        r.run(10**6, max_steps=1)
        c = r.active[:, : max(1, r.active.shape[1] - 1)].T @ r.residual
        assert np.ptp(c) < 1e-9


def test_least_angle_equals_explicit_columns():
    x, y, _ = problem()
    r = kernels.make("lars", x, y, 300, seed=3).run(4)
    made = np.column_stack([r.active[:, i] * r.sign[i] for i, e in enumerate(r.entries) if e[0] == kernels.DUMMY])
    q = kernels.make("lars", x, y, made.shape[1], given=made).run(4)
    assert [e for e in q.entries if e[0] == kernels.REAL] == [e for e in r.entries if e[0] == kernels.REAL]


def test_pursuit_residual_is_orthogonal_and_equals_full_steps():
    x, y, _ = problem()
    r = kernels.make("omp", x, y, 100, seed=4).run(3)
    assert np.abs(r.active.T @ r.residual).max() < 1e-8
    a = kernels.make("afs", x, y, 100, rho=1.0, seed=4).run(3)
    assert a.entries == r.entries


def test_races_stop_at_once_when_the_count_is_reached():
    x, y, _ = problem()
    r = kernels.make("lars", x, y, 100, seed=5).run(2)
    n = len(r.path)
    assert len(r.run(2).path) == n
    assert r.run(3).n_made == 3  # goes on from where it was


def test_edges_constant_response_and_duplicate_columns():
    x, _, _ = problem()
    assert kernels.make("lars", x, np.zeros(len(x)), 10).run(1).status == "constant response"
    x2 = np.column_stack([x, x[:, 0]])
    y = x[:, 0] - x[:, 0].mean()
    r = kernels.make("lars", x2, y + 0.01 * x[:, 1], 50, seed=1).run(1)
    reals = [j for k, j, _ in r.entries if k == kernels.REAL]
    assert 0 in reals and x.shape[1] not in reals
    with pytest.raises(ValueError):
        kernels.make("nope", x, y, 1)


def test_tails_against_known_values():
    assert abs(tails.t_two_sided(2.228138852, 10)[0] - 0.05) < 1e-8
    assert abs(tails.normal_tail(1.959963985)[0] - 0.05) < 1e-8


def test_equi_knockoffs_keep_the_gram_matrix():
    x, _, _ = problem(120, 20)
    k = rivals.equi_knockoffs(x, 1)
    g, c = x.T @ x, x.T @ k
    assert np.abs(k.T @ k - g).max() < 1e-8
    off = ~np.eye(20, dtype=bool)
    assert np.abs((g - c)[off]).max() < 1e-8


def test_false_discoveries_are_held_in_a_small_study():
    fdp = []
    for rep in range(12):
        x, y, true = studies.problem(3, rep, 80, 80, 5, 3.0)
        got = studies.local_selection(x, y, 0.2, 10, 400, 6, rep)
        fdp.append(len(np.setdiff1d(got, true)) / max(len(got), 1))
    assert np.mean(fdp) <= 0.3


def test_saved_races_and_paths_go_on_as_if_never_stopped():
    from fdrspark.plans.explicit import TerminatingPath

    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 20))
    x -= x.mean(0)
    x /= np.linalg.norm(x, axis=0)
    d = kernels.explicit_null(60, 40, "gaussian", 3)
    y = x[:, :3].sum(1) * 3 + rng.standard_normal(60) * 0.2
    y -= y.mean()
    whole = kernels.make("lars", x, y, 40, seed=2).run(6)
    part = kernels.LeastAngle.load(kernels.make("lars", x, y, 40, seed=2).run(2).save(), x, y).run(6)
    assert part.entries == whole.entries and np.allclose(part.fit, whole.fit)
    with pytest.raises(ValueError):
        kernels.LeastAngle.load(whole.save(), x[:, :5], y)
    whole = TerminatingPath(x, d, y).run(5)
    part = TerminatingPath.load(TerminatingPath(x, d, y).run(2).save(), x, d, y).run(5)
    assert part.actions == whole.actions and np.allclose(part.coef, whole.coef) and whole.active_nulls == 5
    # the same order as the race over explicit null columns
    race = kernels.LeastAngle(x, y, 40, given=d).run(5)
    assert [a - 1 for a in whole.actions] == [i if kind == "real" else 20 + i for kind, i, _ in race.entries]


def test_lasso_paths_meet_their_conditions_and_drop():
    from fdrspark.plans.explicit import TerminatingPath, by_null_count

    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 6))
    x = np.column_stack([base, base @ rng.standard_normal((6, 10)) + 0.3 * rng.standard_normal((40, 10)), base[:, 0]])  # strong ties and a copy
    x -= x.mean(0)
    x /= np.linalg.norm(x, axis=0)
    y = base @ rng.standard_normal(6)
    y -= y.mean()
    path = TerminatingPath(x, kernels.explicit_null(40, 10, "gaussian", 1), y, lasso=True).run(0, early_stop=False)
    assert any(a < 0 for a in path.actions) and path.status == "done"
    assert all(a >= b - 1e-9 for a, b in zip(path.rss, path.rss[1:], strict=False))
    for b in path.path[1:-1]:
        c = path.z.T @ (path.y - path.z @ b)
        top = np.abs(c).max()
        on = np.flatnonzero(np.abs(b) > 1e-9)
        assert np.allclose(np.abs(c[on]), top, atol=1e-6) and (np.sign(c[on]) == np.sign(b[on])).all()
    assert 0 in by_null_count(path)


def test_a_score_hook_takes_the_place_of_the_residual():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 8))
    x -= x.mean(0)
    x /= np.linalg.norm(x, axis=0)
    y = x[:, 2] * 3 - x[:, 5] * 2 + 0.01 * rng.standard_normal(50)
    y -= y.mean()
    plain = kernels.make("omp", x, y, 20, seed=1).run(1)
    hooked = kernels.make("omp", x, y, 20, seed=1, hook=lambda y, fit: y - fit).run(1)
    assert hooked.entries[:2] == plain.entries[:2] == [("real", 2, 0), ("real", 5, 0)]
    robust = kernels.make("afs", x, y, 20, seed=1, rho=0.5, hook=lambda y, fit: np.sign(y - fit)).run(1)
    assert ("real", 2, 0) in robust.entries
    with pytest.raises(ValueError):
        kernels.make("lars", x, y, 20, hook=lambda y, fit: y)
