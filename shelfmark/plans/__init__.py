"""Models, jobs and the registered queries."""
