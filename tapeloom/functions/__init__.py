"""Column factories: no function here triggers a job."""
