"""paddock: vehicle telemetry and lap analytics as plain DataFrame functions."""
