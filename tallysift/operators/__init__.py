"""Table-to-table operators. Functions named ``fit_*`` run jobs; all others only extend a plan."""
