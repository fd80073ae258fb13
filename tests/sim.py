"""Wave semantics of a flow in plain Python, one run at a time: the oracle of the batch compiler."""

from loomspark.plans.containment import contains_value


def simulate(flow, given, handlers):
    """handlers[slug](value) returns a value or raises; gives (states, run_status, output)."""
    state = {s.slug: {"status": "created", "output": None, "reason": None} for s in flow.steps}
    cascade, alive = {s.slug: False for s in flow.steps}, True
    for wave in flow.waves():
        unmet = {}
        for s in wave:
            if any(cascade[d] for d in s.depends_on):
                cascade[s.slug] = True
                state[s.slug].update(status="skipped", reason="dependency_skipped")
                continue
            value = {d: state[d]["output"] for d in s.depends_on if state[d]["status"] == "completed"} if s.depends_on else given
            unmet[s.slug] = not ((s.if_ is None or contains_value(value, s.if_)) and (s.if_not is None or not contains_value(value, s.if_not)))
        if not alive:
            continue
        blocked = next((s.slug for s in wave if s.when_unmet == "fail" and unmet.get(s.slug)), None)
        if blocked:
            state[blocked].update(status="failed")
            alive = False
            continue
        failed = False
        for s in wave:
            if s.slug not in unmet:
                continue
            if unmet[s.slug]:
                state[s.slug].update(status="skipped", reason="condition_unmet")
                cascade[s.slug] = s.when_unmet == "skip-cascade"
                continue
            try:
                if s.kind == "map":
                    parent = state[s.depends_on[0]] if s.depends_on else None
                    items = given if parent is None else parent["output"] if parent["status"] == "completed" else []
                    output = [handlers[s.slug](x) for x in items]
                else:
                    output = handlers[s.slug]({d: state[d]["output"] for d in s.depends_on if state[d]["status"] == "completed"} if s.depends_on else given)
                state[s.slug].update(status="completed", output=output)
            except ValueError:
                if s.when_exhausted == "fail":
                    state[s.slug].update(status="failed")
                    failed = True
                else:
                    state[s.slug].update(status="skipped", reason="handler_failed")
                    cascade[s.slug] = s.when_exhausted == "skip-cascade"
        alive = alive and not failed
    done = {s.slug: state[s.slug]["output"] for s in flow.leaves() if state[s.slug]["status"] == "completed"}
    return state, "completed" if alive else "failed", (done or None) if alive else None
