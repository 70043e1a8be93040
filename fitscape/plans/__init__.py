"""Test carriers, registered queries with their SQL, and jobs."""
