"""DataFrame -> DataFrame operators over tables of scans."""
