"""DataFrame operators: joins, components, dedupe, sync, scoring, listing."""
