"""Column expressions, plan-time name rules and fixed values."""
