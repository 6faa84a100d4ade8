"""plans: operators put together into jobs, and the registered queries."""
