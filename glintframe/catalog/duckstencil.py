"""DuckDB steps of the stencils, for the cross-check on 8 x 8 frames."""

from glintframe.operators.stencil import taps

N = 8


def fold(t, border, n=N):
    if border in ("replicate", "edge"):
        return f"greatest(0,least({n - 1},{t}))"
    if border == "reflect":
        m = f"((({t})%{2 * n}+{2 * n})%{2 * n})"
        return f"(case when {m}<{n} then {m} else {2 * n - 1}-{m} end)"
    p = 2 * n - 2
    m = f"((({t})%{p}+{p})%{p})"
    return f"(case when {m}<{n} then {m} else {p}-{m} end)"


def line_pass(out, src, axis, pad, border, new, replaced, n=N):
    other = "y" if axis == "x" else "x"
    w = f"(partition by scene, frame, {other} order by t"
    rep = ", ".join(f"{e.replace('<w>', w)} as {c}" for c, e in replaced.items())
    add = "".join(f", {e.replace('<w>', w)} as {c}" for c, e in new.items())
    star = f"* replace ({rep})" if replaced else "*"
    return [(f"{out}_p", f"select s.*, r.t from {src} s join (select range::int t from range({-pad},{n + pad})) r on s.{axis}={fold('r.t', border, n)}"),
            (out, f"select * exclude (t) from (select {star}{add} from {out}_p) where t between 0 and {n - 1}")]


def both(out, src, cols, pad, border, expr, n=N):
    first = [(f"{out}_0", f"select *, {', '.join(f'({e})::double {c}' for c, e in cols.items())} from {src}")]
    a = line_pass(f"{out}_x", f"{out}_0", "x", pad, border, {}, {c: expr(c) for c in cols}, n)
    b = line_pass(out, f"{out}_x", "y", pad, border, {}, {c: expr(c) for c in cols}, n)
    return [*first, *a, *b]


def box(out, src, cols, k, border="reflect", n=N):
    p = k // 2
    return both(out, src, cols, p, border, lambda c: f"avg({c}) over <w> rows between {p} preceding and {p} following)", n)


def blur(out, src, cols, sigma, border="replicate", n=N):
    bell = taps(sigma)
    r = len(bell) // 2
    term = lambda c, d, t: f"{'lead' if d >= 0 else 'lag'}({c},{abs(d)}) over <w>)*{t!r}::double"
    return both(out, src, cols, r, border, lambda c: "(" + "+".join(term(c, d, t) for d, t in zip(range(-r, r + 1), bell)) + ")", n)


def guided(out, src, guide, value, radius, eps, name, border="replicate", n=N):
    k = 2 * radius + 1
    a = box(f"{out}_1", src, {"mg": guide, "mv": value, "cg": f"{guide}*{guide}", "cx": f"{guide}*{value}"}, k, border, n)
    cov = "(cx-mg*mv)" if guide != value else "greatest(cx-mg*mv,0)"
    b = box(f"{out}_2", f"{out}_1", {"ma": f"{cov}/(greatest(cg-mg*mg,0)+{eps}::double)", "mb": f"mv-{cov}/(greatest(cg-mg*mg,0)+{eps}::double)*mg"}, k, border, n)
    return [*a, *b, (out, f"select * exclude (mg,mv,cg,cx,ma,mb), ma*{guide}+mb {name} from {out}_2")]


def gradient(out, src, value, gx="gx", gy="gy"):
    d = lambda w: (f"coalesce((lead({value}) over {w}-lag({value}) over {w})/2, lead({value}) over {w}-{value}, {value}-lag({value}) over {w}, 0)")
    return [(out, f"select *, {d('(partition by scene,frame,y order by x)')} {gx}, {d('(partition by scene,frame,x order by y)')} {gy} from {src}")]


def sobel(out, src, value, gx="gx", gy="gy", gm="gmag", n=N):
    L = lambda c: f"lag({c}) over <w>)"
    R = lambda c: f"lead({c}) over <w>)"
    a = line_pass(f"{out}_x", src, "x", 1, "reflect101", {"sd": f"{R(value)}-{L(value)}", "sm": f"{L(value)}+2*{value}+{R(value)}"}, {}, n)
    b = line_pass(f"{out}_y", f"{out}_x", "y", 1, "reflect101", {gx: f"{L('sd')}+2*sd+{R('sd')}", gy: f"{R('sm')}-{L('sm')}"}, {}, n)
    return [*a, *b, (out, f"select * exclude (sd,sm), sqrt({gx}*{gx}+{gy}*{gy}) {gm} from {out}_y")]


def normalized(out, src, cols):
    """cols: name -> (expression, percentile)."""
    q = ", ".join(f"quantile_cont({e},{p}) over (partition by scene,frame) q_{n}" for n, (e, p) in cols.items())
    v = ", ".join(f"(case when q_{n}>1e-8::double then least(1,({e})/q_{n}) else 0 end)::double {n}" for n, (e, p) in cols.items())
    return [(out, f"select * exclude ({', '.join('q_' + n for n in cols)}), {v} from (select *, {q} from {src})")]


def structure(out, src, lum):
    s = guided(f"{out}a", src, lum, lum, 7, 0.01, "base", "reflect")
    s += normalized(f"{out}b", f"{out}a", {"pos_": (f"greatest({lum}-base,0)", 0.995), "neg_": (f"greatest(base-{lum},0)", 0.995)})
    s += gradient(f"{out}c", f"{out}b", lum, "sgx", "sgy")
    s += box(f"{out}d", f"{out}c", {"jxx": "sgx*sgx", "jyy": "sgy*sgy", "jxy": "sgx*sgy"}, 15)
    s += box(f"{out}e", f"{out}d", {"nb": "neg_"}, 9)
    s += normalized(f"{out}f", f"{out}e", {"near_": ("nb", 0.99), "edge_": ("sqrt(sgx*sgx+sgy*sgy)", 0.99)})
    s += box(f"{out}g", f"{out}f", {"pb": "sqrt(greatest(0,least(1,pos_*near_)))", "eb": "edge_"}, 9)
    s += normalized(f"{out}h", f"{out}g", {"pn": ("pb", 0.99), "en": ("eb", 0.99)})
    pair = "sqrt(greatest(0,least(1,pos_*near_)))"
    coh = "sqrt(power(jxx-jyy,2)+4*jxy*jxy)/(jxx+jyy+1e-6::double)"
    return s + [(out, f"select *, {coh} coh, cbrt(greatest(0,least(1,greatest({pair},pn)*{coh}*greatest(edge_,en)))) structure from {out}h")]


def plus(out, src, value, name, agg):
    w = lambda o, a: f"{agg}({value}) over (partition by scene,frame,{o} order by {a} rows between 1 preceding and 1 following)"
    f = "greatest" if agg == "max" else "least"
    return [(out, f"select *, {f}({w('y', 'x')},{w('x', 'y')}) {name} from {src}")]


def down(out, src, factor, cols):
    return [(out, f"select scene, frame, y//{factor} y, x//{factor} x, {8 // factor} h, {8 // factor} w, {', '.join(f'avg({c}) {c}' for c in cols)} from {src} group by scene, frame, y//{factor}, x//{factor}")]


def up(out, full, small, factor, linear=(), near=()):
    """Bilinear by half-pixel centres (replicated border), or nearest."""
    n = N // factor
    src = lambda p: f"((f.{p}+0.5::double)/{factor}-0.5::double)"
    lo = lambda p: f"greatest(0,least({n - 1},floor({src(p)})))::int"
    hi = lambda p: f"greatest(0,least({n - 1},floor({src(p)})+1))::int"
    fr = lambda p: f"({src(p)}-floor({src(p)}))"
    lin = ", ".join(f"(a.{c}*(1-{fr('x')})+b.{c}*{fr('x')})*(1-{fr('y')})+(c.{c}*(1-{fr('x')})+d.{c}*{fr('x')})*{fr('y')} {c}" for c in linear)
    ne = ", ".join(f"e.{c} {c}" for c in near)
    joins = "".join(f" join {small} {al} on {al}.scene=f.scene and {al}.frame=f.frame and {al}.y={yy} and {al}.x={xx}"
                    for al, yy, xx in (("a", lo("y"), lo("x")), ("b", lo("y"), hi("x")), ("c", hi("y"), lo("x")), ("d", hi("y"), hi("x")))) if linear else ""
    joins += f" join {small} e on e.scene=f.scene and e.frame=f.frame and e.y=f.y//{factor} and e.x=f.x//{factor}" if near else ""
    return [(out, f"select f.*, {', '.join(x for x in (lin, ne) if x)} from {full} f{joins}")]
