"""Part of tidewire; see README.md."""
