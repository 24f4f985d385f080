"""Reading raw sheets and files, writing results."""
